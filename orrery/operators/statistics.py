"""Summaries, correlation, tests and order statistics of columns and vectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import distributions as D
from orrery.plans.storage import cut


def summarize(long: DataFrame, n: int | None = None, weighted: bool = False) -> DataFrame:
    """Per component of long entries (row_id, idx, value[, weight]): mean, variance (weighted,
    unbiased), count, nnz, max, min, norm_l1, norm_l2. Absent entries count as zeros if ``n`` (the
    number of rows, unweighted) is given."""
    w = F.col("weight") if weighted else F.lit(1.0)
    x = F.col("value")
    sums = long.groupBy("idx").agg(
        F.count("*").alias("c"),
        F.sum(w).alias("w"),
        F.sum(w * w).alias("w2"),
        F.sum(w * x).alias("s"),
        F.sum(w * x * x).alias("ss"),
        F.sum((x != 0).cast("long")).alias("nnz"),
        F.max("value").alias("mx"),
        F.min("value").alias("mn"),
        F.sum(w * F.abs(x)).alias("l1"),
    )
    rows = F.lit(n).cast("long") if n is not None else F.col("c")
    absent = rows - F.col("c")
    total, squares = F.col("w") + absent, F.col("w2") + absent
    mean = F.col("s") / total
    spread = F.greatest(F.col("ss") - F.col("s") * F.col("s") / total, F.lit(0.0))
    bound = lambda best, c: F.when(absent > 0, best(F.col(c), F.lit(0.0))).otherwise(F.col(c))
    return sums.select(
        "idx",
        mean.alias("mean"),
        (spread / F.nullif(total - squares / total, F.lit(0.0))).alias("variance"),
        rows.alias("count"),
        "nnz",
        bound(F.greatest, "mx").alias("max"),
        bound(F.least, "mn").alias("min"),
        F.col("l1").alias("norm_l1"),
        F.sqrt("ss").alias("norm_l2"),
    )


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns: one pass of grouped sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.lit(a == b), 1.0).otherwise(F.col(f"c{k}")).alias("corr")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("r")).select("r.*")


def average_ranks(df: DataFrame, row_id: str, column: str, name: str = "rank") -> DataFrame:
    """(row_id, rank), ties at their average. The distinct values are ordered with their counts, and only
    those: rank = rows below + (ties + 1) / 2. Running sums go over range partitions."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    below = running_total(counts, "v", "n", "below")
    ranks = below.select("v", (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.select(row_id, F.col(column).alias("v")).join(ranks, "v").select(row_id, name)


def running_total(df: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """``df`` (unique ``key``) with the sum of ``n`` over all rows of smaller keys."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("__p").agg(F.sum(n).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("__p", before.alias("__start")))
    here = F.coalesce(F.sum(n).over(Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(starts, "__p").withColumn(name, F.col("__start") + here).drop("__p", "__start")


def spearman(df: DataFrame, row_id: str, a: str, b: str) -> DataFrame:
    """One row (corr): Pearson's correlation of average ranks."""
    ra, rb = average_ranks(df, row_id, a, "ra"), average_ranks(df, row_id, b, "rb")
    return ra.join(rb, row_id).agg(F.corr("ra", "rb").alias("corr"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("observed"))


def chi_square_independence(table: DataFrame, *group: str) -> DataFrame:
    """(statistic, df[, p_value]) for each group of a contingency table (a, b, observed): all from
    margins, without filling empty cells: sum of O^2 / E minus N."""
    keys = list(group)
    of = lambda *k: Window.partitionBy(*keys, *k)
    rows = table.groupBy(*keys, "a").agg(F.sum("observed").alias("ra"))
    columns = table.groupBy(*keys, "b").agg(F.sum("observed").alias("rb"))
    joined = table.join(rows, [*keys, "a"]).join(columns, [*keys, "b"])
    total = joined.withColumn("n", F.sum("observed").over(of()))
    o = F.col("observed").cast("double")
    stat = total.groupBy(*keys).agg(
        (F.sum(o * o * F.col("n") / (F.col("ra") * F.col("rb"))) - F.first("n")).alias("statistic"),
        ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"),
    )
    return stat


def chi_square_by_feature(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(idx, statistic, df, p_value) of each component against the label; df 0 gives p-value 1."""
    table = df.select(F.posexplode(vector).alias("idx", "a"), F.col(label).alias("b")).groupBy("idx", "a", "b").agg(F.count("*").alias("observed"))
    found = chi_square_independence(table, "idx")
    rows = [(r.idx, r.statistic, int(r.df), D.chi_square_tail(r.statistic, r.df)) for r in found.toLocalIterator()]
    return df.sparkSession.createDataFrame(rows, "idx int, statistic double, df int, p_value double")


def chi_square_fit(df: DataFrame, category: str, expected: dict | None = None) -> DataFrame:
    """(statistic, df) of category counts against expected shares, uniform by default."""
    counts = df.groupBy(F.col(category).alias("k")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    if expected is None:
        e = F.sum("n").over(w) / F.count("*").over(w)
    else:
        total = sum(expected.values())
        share = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v / total))])
        e = F.sum("n").over(w) * share[F.col("k")]
    cells = counts.withColumn("e", e)
    return cells.agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("statistic"), (F.count("*") - 1).alias("df"))


def ks_test(df: DataFrame, column: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """(statistic, n): greatest distance between the empirical distribution and ``cdf``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    points = running_total(counts, "v", "n", "below").withColumn("total", total)
    p = cdf(F.col("v"))
    gap = F.greatest(F.abs(p - F.col("below") / F.col("total")), F.abs((F.col("below") + F.col("n")) / F.col("total") - p))
    return points.agg(F.max(gap).alias("statistic"), F.max("total").alias("n"))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov) of the upper triangle, sample covariance."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{k}") for k, (i, j) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{k}").alias("cov")) for k, (i, j) in enumerate(pairs)])
    return row.select(F.explode(items).alias("r")).select("r.*")


def top_by_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. A first pass keeps n rows for each key and salt, so a hot key
    never meets in one task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    place = lambda w: F.row_number().over(w.orderBy(*order))
    some = df.withColumn("__salt", salt).withColumn("__r", place(Window.partitionBy(key, "__salt"))).where(F.col("__r") <= n)
    return some.withColumn("rank", place(Window.partitionBy(key))).where(F.col("rank") <= n).drop("__salt", "__r")


def sliding(df: DataFrame, order: str, value: str, size: int, step: int = 1) -> DataFrame:
    """(start, window) of full windows over the global order of a unique key: positions are dense
    ids, each row goes to the windows that hold it, and windows are grouped by their number."""
    from orrery.operators.text import dense_ids

    placed = dense_ids(df.select(order, value), order, "at")
    first = F.greatest(F.ceil((F.col("at") - (size - 1)) / step), F.lit(0))
    last = F.floor(F.col("at") / step)
    member = placed.where(first <= last).select("at", value, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("w"))
    grouped = member.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("rows"))
    return grouped.where(F.size("rows") == size).select((F.col("w") * step).alias("start"), F.transform("rows", lambda r: r[value]).alias("window"))


def auc(df: DataFrame, score: str, label: str, ties: bool = True) -> DataFrame:
    """One row (auc): rank-sum area under the ROC curve, from the counts of each distinct score."""
    y = (F.col(label) > 0).cast("long")
    counts = df.groupBy(F.col(score).alias("v")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    below = running_total(counts.withColumn("neg", F.col("n") - F.col("pos")), "v", "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * (0.5 if ties else 0.0)))
    return below.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def quantiles(df: DataFrame, column: str, at: list[float], accuracy: int | None = None) -> DataFrame:
    """(q, value): exact (nearest rank) without ``accuracy``, else from a mergeable sketch. Nulls count nowhere;
    without values each value is null."""
    spark = df.sparkSession
    if accuracy is not None:
        row = df.agg(F.percentile_approx(column, [float(q) for q in at], accuracy).alias("v"))
        return row.select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("k") + 1).alias("q"), "value")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    below = cut(running_total(counts, "value", "n", "below"), "below")
    total = below.agg(F.sum("n")).first()[0] or 0
    # ranks from the decimals as written: 0.1 * 30 as doubles is above 3
    ranks = [(float(q), max(1, math.ceil(Fraction(str(q)) * total))) for q in at]
    asked = F.broadcast(spark.createDataFrame(ranks, "q double, rank long"))
    # a filter of ranks first, then the few rows are named
    found = below.where(reduce(Column.__or__, [F.lit(r).between(F.col("below") + 1, F.col("below") + F.col("n")) for r in {r for _, r in ranks}], F.lit(False)))
    return asked.join(F.broadcast(found), (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("n")), "left").select("q", "value")


def kll_quantiles(df: DataFrame, column: str, at: list[float], k: int = 128) -> DataFrame:
    """(q, value) from a KLL sketch, which can be stored and merged."""
    sketch = df.agg(F.expr(f"kll_sketch_agg_double(cast({column} as double), {k})").alias("s"))
    return sketch.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.expr(f"kll_sketch_get_quantile_double(s, cast({q} as double))").alias("value")) for q in at])).alias("r")).select("r.*")


def gaussian_log_pdf(x, mean, cov):
    """Log density of a multivariate normal; directions without variance are left out."""
    import numpy as np

    values, axes = np.linalg.eigh(np.asarray(cov, float))
    kept = values > max(values.max(), 0) * len(values) * np.finfo(float).eps
    d = (np.asarray(x, float) - mean) @ axes[:, kept]
    return -0.5 * (np.log(2 * math.pi * values[kept]).sum() + (d * d / values[kept]).sum(-1))


def active_features(df: DataFrame, features: str = "features") -> DataFrame:
    """One row (active, rows): how many indexes of a sparse vector column occur, which is the size of a model
    over it, and how many rows there are."""
    active = df.select(F.explode(F.col(features)["indices"]).alias("i")).distinct().agg(F.count("*").alias("active"))
    return active.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row beside one row


def partition_rows(df: DataFrame) -> DataFrame:
    """(partition, rows) of the partitions that have rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
