"""Model parameters as a keyed table (idx, slot, value): "pull" is a join, "push" a grouped sum.

Tables are immutable; an update is a projection. With few parameters the same interface inlines
them as an array literal, so that a step is one aggregation without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.storage import cut

#: Parameters up to this index are inlined as a literal array.
INLINE = 4096


def zeros(entries: DataFrame, *slots: str) -> DataFrame:
    """(idx, *slots) with 0.0 for every index that occurs in long entries."""
    return entries.select("idx").distinct().select("idx", *[F.lit(0.0).alias(s) for s in slots])


def pull(entries: DataFrame, table: DataFrame) -> DataFrame:
    return entries.join(table, "idx", "left").fillna(0.0, [c for c in table.columns if c != "idx"])


def push(deltas: DataFrame, *values: str) -> DataFrame:
    return deltas.groupBy("idx").agg(*[F.sum(v).alias(v) for v in values])


def increment(table: DataFrame, deltas: DataFrame, slot: str, delta: str) -> DataFrame:
    d = push(deltas.select("idx", F.col(delta).alias("__d")), "__d")
    out = table.join(d, "idx", "full").fillna(0.0)
    return out.withColumn(slot, F.col(slot) + F.col("__d")).drop("__d")


def filled(spark: SparkSession, n: int, value: float = 0.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(value).alias("value"))


def random_uniform(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    from orrery.operators.tuning import uniform

    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(low) + uniform(seed, "id") * (high - low)).alias("value"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))


def map_values(table: DataFrame, f) -> DataFrame:
    return table.withColumn("value", f(F.col("value")))


def zip_values(a: DataFrame, b: DataFrame, f, *, keep_missing: bool = True) -> DataFrame:
    """Element by element; absent entries are zeros."""
    both = a.select("idx", F.col("value").alias("x")).join(b.select("idx", F.col("value").alias("y")), "idx", "full" if keep_missing else "inner").fillna(0.0, ["x", "y"])
    return both.select("idx", f(F.col("x"), F.col("y")).alias("value"))


def reductions(table: DataFrame) -> DataFrame:
    """One row: total, max, min, nnz, size, norm2."""
    v = F.col("value")
    return table.agg(F.sum(v).alias("total"), F.max(v).alias("max"), F.min(v).alias("min"), F.sum((v != 0).cast("long")).alias("nnz"), F.count("*").alias("size"), F.sqrt(F.sum(v * v)).alias("norm2"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.toDF("idx", "x").join(b.toDF("idx", "y"), "idx").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def snapshot(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def literal(table: DataFrame, slot: str = "value") -> Column | None:
    """The slot as an array literal if all indexes are small, else None."""
    top = table.agg(F.max("idx")).first()[0]
    if top is None or top >= INLINE:
        return None
    w = [0.0] * (top + 1)
    for r in table.select("idx", slot).toLocalIterator():
        w[r[0]] = r[1]
    return F.array(*[F.lit(float(x)) for x in w])


class Optimizer:
    """Update rules on the table; ``grad`` is a column beside the slots."""

    slots: tuple[str, ...] = ("value",)

    def __init__(self, rate: float = 0.1, **more: float) -> None:
        self.rate, self.more = rate, more

    def step(self, t: DataFrame, k: int) -> DataFrame:
        return t.withColumn("value", F.col("value") - self.rate * F.col("grad"))


class Momentum(Optimizer):
    slots = ("value", "velocity")

    def step(self, t, k):
        t = t.withColumn("velocity", F.lit(self.more.get("momentum", 0.9)) * F.col("velocity") + F.col("grad"))
        return t.withColumn("value", F.col("value") - self.rate * F.col("velocity"))


class Adagrad(Optimizer):
    slots = ("value", "square")

    def step(self, t, k):
        t = t.withColumn("square", F.col("square") + F.col("grad") * F.col("grad"))
        return t.withColumn("value", F.col("value") - self.rate * F.col("grad") / (F.sqrt("square") + self.more.get("epsilon", 1e-8)))


class Adam(Optimizer):
    slots = ("value", "first", "second")

    def step(self, t, k):
        b1, b2 = self.more.get("beta1", 0.9), self.more.get("beta2", 0.999)
        t = t.withColumns({"first": b1 * F.col("first") + (1 - b1) * F.col("grad"), "second": b2 * F.col("second") + (1 - b2) * F.col("grad") * F.col("grad")})
        m, v = F.col("first") / (1 - b1**k), F.col("second") / (1 - b2**k)
        return t.withColumn("value", F.col("value") - self.rate * m / (F.sqrt(v) + self.more.get("epsilon", 1e-8)))


class Ftrl(Optimizer):
    slots = ("value", "z", "n")

    def step(self, t, k):
        alpha, beta = self.more.get("alpha", 0.1), self.more.get("beta", 1.0)
        g = F.col("grad")
        s = (F.sqrt(F.col("n") + g * g) - F.sqrt("n")) / alpha
        t = t.withColumn("z", F.col("z") + g - s * F.col("value")).withColumn("n", F.col("n") + g * g)
        return t.withColumn("value", ftrl_weight(F.col("z"), F.col("n"), alpha, beta, self.more.get("lambda1", 0.1), self.more.get("lambda2", 0.1)))


def ftrl_weight(z: Column, n: Column, alpha: float, beta: float, lambda1: float, lambda2: float) -> Column:
    return F.when(F.abs(z) <= lambda1, 0.0).otherwise(-(z - F.signum(z) * lambda1) / (lambda2 + (beta + F.sqrt(n)) / alpha))


OPTIMIZERS = {"sgd": Optimizer, "momentum": Momentum, "adagrad": Adagrad, "adam": Adam, "ftrl": Ftrl}


def decayed(kind: str, rate: float, epoch: int, alpha: float = 0.001, beta: float = 0.01, interval: int = 100) -> float:
    """Learning rate of an epoch: standard max(rate / sqrt(1 + alpha * epoch), rate / 5), or warm restarts."""
    import math

    if kind == "standard":
        return max(rate / math.sqrt(1 + alpha * epoch), rate / 5)
    if kind == "warm_restarts":
        return beta * rate + (1 - beta) * rate * (1 + math.cos(math.pi * (epoch % interval) / interval)) / 2
    return rate


def train_step(table: DataFrame, grads: DataFrame, optimizer: Optimizer, k: int) -> DataFrame:
    """One synchronous update from pushed gradients (idx, grad)."""
    missing = [s for s in optimizer.slots if s not in table.columns]
    t = table.select("*", *[F.lit(0.0).alias(s) for s in missing]).join(grads, "idx", "left").fillna(0.0, ["grad"])
    return cut(optimizer.step(t, k).drop("grad"), "params")
