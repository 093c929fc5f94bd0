"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.storage import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node that each node of ``links`` (u long, v long) can reach: (node, component).

    Alternating large-star and small-star rounds: each is a grouped minimum (combined before the
    shuffle) and a join back, and every round's links are written to the shared folder. Null ends
    are ignored, repeated links and self links count once; an empty table gives an empty result. The number of rounds grows
    with the logarithm of the longest path; what isn't done after ``max_rounds`` is an error.
    """
    links = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        links = cut(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == (now.n, now.s):
            break
        state = (now.n, now.s)
    else:
        raise RuntimeError(f"components aren't complete after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
