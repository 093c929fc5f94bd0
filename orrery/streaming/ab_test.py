"""Streams: significance of an A/B experiment over event time, and online FTRL over micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import distributions as D
from orrery.operators import linear
from orrery.plans.storage import cut


def group_statistics(samples: DataFrame, is_experiment: Column, value: Column, time: Column | None = None, width: str | None = None, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """(window_start, experiment, n, mean, variance) for batch or streaming ``samples``; without a
    width there is one window for all history."""
    rows = samples.select(is_experiment.alias("experiment"), value.cast("double").alias("x"), (time if time is not None else F.current_timestamp()).alias("t"))
    if lateness:
        rows = rows.withWatermark("t", lateness)
    keys = [F.window("t", width, slide).alias("w") if slide else F.window("t", width).alias("w")] if width else []
    out = rows.groupBy(*keys, "experiment").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    start = F.col("w.start") if width else F.lit(None).cast("timestamp")
    return out.select(start.alias("window_start"), "experiment", "n", "mean", "variance")


def paired(stats: DataFrame) -> DataFrame:
    """One row for each window that has both groups."""
    side = lambda flag, s: stats.where(F.col("experiment") == flag).select(F.col("window_start").alias(f"w{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("n", "mean", "variance")])
    a, b = side(True, "1"), side(False, "0")
    return a.join(b, F.col("w1").eqNullSafe(F.col("w0"))).withColumnRenamed("w1", "window_start").drop("w0")


def t_statistic(pairs: DataFrame, welch: bool = True) -> DataFrame:
    """Adds statistic and df: Welch's test, or Student's with pooled variance."""
    n1, n0, v1, v0 = (F.col(c) for c in ("n1", "n0", "variance1", "variance0"))
    diff = F.col("mean1") - F.col("mean0")
    if welch:
        a, b = v1 / n1, v0 / n0
        return pairs.withColumns({"statistic": diff / F.sqrt(a + b), "df": (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1))})
    pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    return pairs.withColumns({"statistic": diff / F.sqrt(pooled * (1 / n1 + 1 / n0)), "df": (n1 + n0 - 2).cast("double")})


def p_value(statistic: float, df: float) -> float:
    return D.t_two_sided(statistic, df)


class StreamingTest:
    """Collects micro-batches: the first ``peace`` are ignored, the last ``window`` (0: all) count.
    ``update`` is a foreachBatch function; ``result`` has the newest test."""

    def __init__(self, peace: int = 0, window: int = 0, welch: bool = True) -> None:
        self.peace, self.window, self.welch, self.seen = peace, window, welch, 0
        self.batches: list[list[tuple]] = []
        self.result: dict | None = None

    def update(self, batch: DataFrame, epoch: int) -> None:
        """``batch``: experiment (boolean), value."""
        self.seen += 1
        if self.seen <= self.peace:
            return
        sums = batch.groupBy("experiment").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).collect()
        self.batches.append([(r.experiment, r.n, r.s, r.q) for r in sums])
        if self.window:
            self.batches = self.batches[-self.window :]
        n, s, q = {}, {}, {}
        for group, a, b, c in (x for part in self.batches for x in part):
            n[group], s[group], q[group] = n.get(group, 0) + a, s.get(group, 0.0) + b, q.get(group, 0.0) + c
        if min(n.get(True, 0), n.get(False, 0)) < 2:
            return
        m = {g: s[g] / n[g] for g in n}
        v = {g: (q[g] - n[g] * m[g] * m[g]) / (n[g] - 1) for g in n}
        if self.welch:
            a, b = v[True] / n[True], v[False] / n[False]
            scale, df = a + b, (a + b) ** 2 / (a * a / (n[True] - 1) + b * b / (n[False] - 1))
        else:
            df = n[True] + n[False] - 2.0
            scale = ((n[True] - 1) * v[True] + (n[False] - 1) * v[False]) / df * (1 / n[True] + 1 / n[False])
        t = (m[True] - m[False]) / scale**0.5
        self.result = {"statistic": t, "df": df, "p_value": D.t_two_sided(t, df), "n": n}


class StreamingFtrl:
    """Online logistic regression: each micro-batch (row_id, label, indices, values) updates the
    state table (idx, z, n), which lives in the shared folder."""

    def __init__(self, state: DataFrame, **rates: float) -> None:
        self.state, self.rates = state, rates

    def update(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        entries = batch.select("row_id", F.explode(F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("value"))).alias("e")).select("row_id", "e.idx", "e.value")
        self.state = cut(linear.ftrl_batch(self.state, entries, batch.select("row_id", "label"), **self.rates), "ftrl")
        batch.unpersist()

    def weights(self) -> DataFrame:
        return linear.ftrl_weights(self.state, **self.rates)
