"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: weights share a multiple of all words; a source stops at ``max_repeats`` times its own
size and the excess goes to the others by weight. That fixed point is min(weight * level, cap)
with the greatest level that a prefix of the sources in the order of cap / weight gives.

A source's documents are dealt by a seeded hash to blocks of about equally many words. Each repetition
of a source draws its blocks in an order of its own (another hash), as many as the target needs; of the last block,
the documents are taken in the order of their hashes until the target is met to the word. That gives each source
an exact quota of blocks. A binary tree splits the quotas of all sources among the output shards:
each node gives its left half a multivariate hypergeometric draw, so each shard gets a random mix with
exact totals. A shard draws the next blocks of each source's order, disjoint from all others', and
shuffles its documents by another hash. What is taken is what the shards draw.

Places in an order come from a tree of sums over prefixes of the hash, at most 256 children to a
node, and shards below the first thousand nodes are split in tasks of their own, so that neither a source with a third of
all rows nor the tree meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.columns import word_count
from orrery.plans.storage import cut, small_side

#: Words of a block, about; more where that would give over 100 million blocks.
BLOCK = 1024
MAX_BLOCKS = 100_000_000
#: Words of an output shard, about.
SHARD_WORDS = 1 << 22
#: Sources of one splitting tree; more sources get several trees over the same shards.
TREE_SOURCES = 4096
#: Nodes of a tree that one task splits; their subtrees go to tasks of their own.
TREE_TOP = 1024
#: Rows of a leaf of the prefix-sum tree, about.
LEAF_ROWS = 256
#: Blocks whose draws are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
#: Columns of ``mix``.
MADE = ("size", "source_size", "target", "taken", "takes")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """``sources`` (source, words) with sid (0.. by code point, null last), weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("sid", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    )
    table = table.withColumn("cap", F.col("words") * F.lit(float(max_repeats)))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    table = table.withColumn("level", (F.lit(float(share)) * F.sum("words").over(everything) - before) / rest)
    table = table.withColumn("level", F.max("level").over(everything))
    return table.select("sid", "source", "words", "weight", F.least(F.col("weight") * F.col("level"), "cap").alias("target"))


def split_quotas(have: np.ndarray, first: np.ndarray, at: int, count: int, leaf: int, seed: int):
    """Split the quotas ``have`` of the sources among shards at .. at + count - 1, down to nodes of at most
    ``leaf`` shards: yields (at, count, have, first) for each. ``first`` are the numbers of the sources' first
    draws, so that nodes draw disjoint ranges. Quotas add up exactly, and the shards of a node differ by
    one block at most at each level of the tree. A node's draw depends on its place, its quotas and the seed only."""
    if count <= leaf:
        yield at, count, have, first
        return
    left = count // 2
    take = int(have.sum()) * left // count
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, at, count])))
    got = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
    yield from split_quotas(got, first, at, left, leaf, seed)
    yield from split_quotas(have - got, first + got, at + left, count - left, leaf, seed)


def shard_draws(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, first, n): the draws first .. first + n - 1 of a source that a shard takes; no row
    for none. ``quotas``: (sid int, n long), the blocks that each source gives."""
    schema = "tree int, at int, count int, sid int, first long, n long"
    steps = [max(1, math.ceil(shards / TREE_TOP)), 1]

    def splitter(leaf: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("sid")
            tree, at, count = (int(x) for x in key)
            sid, parts = pdf.sid.to_numpy(), []
            for a, c, have, first in split_quotas(pdf.n.to_numpy(np.int64), pdf["first"].to_numpy(np.int64), at, count, leaf, seed + tree):
                some = have > 0
                parts.append(pd.DataFrame({"tree": tree, "at": a, "count": c, "sid": sid[some], "first": first[some], "n": have[some]}))
            return pd.concat(parts)

        return run

    nodes = quotas.where("n > 0").select(F.floor(F.col("sid") / TREE_SOURCES).cast("int").alias("tree"), F.lit(0).alias("at"), F.lit(shards).alias("count"), "sid", F.lit(0).cast("long").alias("first"), "n")
    for leaf in steps if steps[0] > 1 else steps[1:]:
        nodes = nodes.groupBy("tree", "at", "count").applyInPandas(splitter(leaf), schema)
    return nodes.select("sid", F.col("at").alias("shard"), "first", "n")


def _hashed(seed: int) -> Column:
    """60 bits that deal a document to its block and its place there: equal for rows that are equal in id and text."""
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(name, 1, 15), 16, 10).cast("long")


def _placed(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (sid, pass, key: hexadecimal and unique, words, further columns) with rank and before: the number
    of rows, and their words, that precede a row in the order of the keys of its (sid, pass)."""
    digits = max(1, math.ceil(math.log(max(count / LEAF_ROWS, 1), 16)))
    group, start = ["sid", "pass"], None
    nodes = rows.groupBy(*group, F.substring("key", 1, digits).alias("node")).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    levels = [*range(2, digits, 2), digits]
    for k, width in enumerate(levels):
        level = nodes.groupBy(*group, F.substring("node", 1, width).alias("node")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        level = level.withColumn("parent", F.substring("node", 1, levels[k - 1] if k else 0))
        line = Window.partitionBy(*group, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = {c: F.coalesce(F.sum(c).over(line), F.lit(0)) for c in ("n", "w")}
        if start is None:
            level = level.withColumns(sums)
        else:
            level = level.withColumns(sums).join(start.toDF(*group, "parent", "up_n", "up_w"), [*group, "parent"])
            level = level.withColumns({"n": F.col("n") + F.col("up_n"), "w": F.col("w") + F.col("up_w")})
        start = level.select(*group, "node", "n", "w")
    line = Window.partitionBy(*group, "node").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    own = {"rank": F.col("n") + F.coalesce(F.count("*").over(line), F.lit(0)), "before": F.col("w") + F.coalesce(F.sum("words").over(line), F.lit(0))}
    return rows.withColumn("node", F.substring("key", 1, digits)).join(start, [*group, "node"]).withColumns(own).drop("node", "n", "w")


def _draws(narrow: DataFrame, table: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, block, takes, left, inside) of the blocks that shards draw: takes is an array of (copy, shard);
    left is the words that the last repetition takes of the source's last block, null for all others, and
    inside, an array of (h, off, total), where the words of that block's documents begin and how many they are."""
    sized = narrow.where("size > 0").join(table, narrow.source.eqNullSafe(table.of), "inner")
    sized = sized.select("sid", F.pmod("h", "n_blocks").alias("block"), "h", "size")
    blocks = cut(sized.groupBy("sid", "block").agg(F.sum("size").alias("words")), "blocks")
    count = blocks.count()
    whole = blocks.groupBy("sid").agg(F.count("*").alias("own"))
    quotas = table.select("sid", "source_size", "quota").where("quota > 0").join(whole, "sid")
    last = F.ceil(F.col("quota") / F.col("source_size")) - 1
    rows = blocks.join(small_side(quotas, 100_000), "sid").withColumn("pass", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "pass", "sid", "block")))
    placed = _placed(rows, count)
    due = F.col("quota") - F.col("pass") * F.col("source_size") - F.col("before")
    drawn = placed.withColumn("due", due).where("due > 0")
    drawn = cut(drawn.select("sid", "block", "pass", (F.col("pass") * F.col("own") + F.col("rank")).alias("draw"), "words", "due"), "drawn")
    by_shard = shard_draws(drawn.groupBy("sid").agg(F.count("*").alias("n")), shards, seed)
    by_shard = by_shard.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    takes = drawn.join(by_shard, ["sid", "draw"]).groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.struct(F.col("pass").alias("copy"), "shard"))).alias("takes"),
        F.max(F.when(F.col("due") < F.col("words"), F.col("due"))).alias("left"),
    )
    # one block of each source at most is taken in part
    parts = drawn.where("due < words").select("sid", "block")
    members = sized.join(small_side(parts, 100_000), ["sid", "block"]).groupBy("sid", "block", "h").agg(F.sum("size").alias("total"))
    line = Window.partitionBy("sid", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    members = members.withColumn("off", F.coalesce(F.sum("total").over(line), F.lit(0)))
    inside = members.groupBy("sid", "block").agg(F.collect_list(F.struct("h", "off", "total")).alias("inside"))
    return cut(takes.join(inside, ["sid", "block"], "left"), "draws")


def mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    max_repeats: float = 2.0,
    shards: int | None = None,
    seed: int = 9,
    keep_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken
    and takes, an array of (copy, words, shard, place): the words that each repetition takes from
    the document's beginning, its shard, and its place in the shard's shuffled order. With
    ``keep_rows`` the columns of ``docs`` come along; those named as the new ones are replaced.
    Without a number of shards there is one for about SHARD_WORDS words of the mix.

    Null and empty texts have size 0 and are never taken; null sources are one source, the last.
    Rows without a doc_id and repeated rows are documents of their own; rows equal in id and text that stand
    where a source's target is met take equal parts of what is left. An empty table gives no
    rows. The result depends on rows, seed and parameters only, not on partitions or order.
    """
    own = [c for c in docs.columns if c not in MADE] if keep_rows else ["doc_id"]
    rows = docs.select(F.struct(*own).alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), _hashed(seed).alias("h"))
    narrow = cut(rows.select("source", "size", "h") if keep_rows else rows, "sizes")
    rows = rows if keep_rows else narrow
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("words")), weights, share, max_repeats)
    sources = cut(sources.withColumn("quota", F.floor(F.col("target") + 1e-6)), "sources")
    total = sources.agg(F.sum("quota")).first()[0] or 0
    block = max(BLOCK, math.ceil(total / MAX_BLOCKS))
    table = sources.select("sid", F.col("source").alias("of"), F.col("words").alias("source_size"), "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).alias("n_blocks"))
    table = small_side(table, 100_000)
    draws = _draws(narrow, table, shards or max(1, math.ceil(total / SHARD_WORDS)), seed)

    rows = rows.join(table, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("h", "n_blocks"))
    taken = rows.where("size > 0").join(small_side(draws, BROADCAST_BLOCKS), ["sid", "block"], "left")
    at = F.get(F.filter("inside", lambda x: x.h == F.col("h")), 0)
    part = F.floor(F.col("size") * F.greatest(F.lit(0), F.least(at.total, F.col("left") - at.off)) / at.total)
    cut_copy = F.size("takes") - 1

    def take(t: Column, i: Column) -> Column:
        words = F.when(F.col("left").isNotNull() & (i == cut_copy), part).otherwise(F.col("size"))
        return F.struct(t["copy"].alias("copy"), words.cast("long").alias("words"), t["shard"].alias("shard"), F.xxhash64(F.lit(seed), t["copy"], F.col("h")).alias("place"))

    none = F.array().cast("array<struct<copy:int,words:bigint,shard:int,place:bigint>>")
    takes = F.coalesce(F.filter(F.transform("takes", take), lambda t: t.words > 0), none)
    kept = ["row", "size", "source_size", "target"]
    out = taken.select(*kept, takes.alias("takes")).union(rows.where("size = 0").select(*kept, none.alias("takes")))
    words = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t.words)
    return out.select("row.*", "size", "source_size", "target", words.alias("taken"), "takes")
