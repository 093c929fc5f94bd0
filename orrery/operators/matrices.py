"""Distributed matrices as tables: coordinates (i, j, value), blocks (bi, bj, block), rows (i, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    both = a.select("i", "j", "value").union(b.select("i", "j", F.col("value") * factor))
    return both.groupBy("i", "j").agg(F.sum("value").alias("value"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner index, grouped sum for each cell."""
    x, y = a.toDF("i", "k", "x"), b.toDF("k", "j", "y")
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def multiply_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """(i, value) for a vector (idx, value)."""
    return a.toDF("i", "k", "x").join(v.toDF("k", "y"), "k").groupBy("i").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def to_blocks(m: DataFrame, size: int = 1024) -> DataFrame:
    """(bi, bj, block): row-major dense blocks of size x size."""
    keyed = m.select((F.col("i") / size).cast("long").alias("bi"), (F.col("j") / size).cast("long").alias("bj"), (F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), F.col("value").cast("double").alias("value"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((size, size))
        np.add.at(block, (pdf.r, pdf.c), pdf.value)
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "block": [block.tobytes()]})

    return keyed.groupBy("bi", "bj").applyInPandas(build, "bi long, bj long, block binary")


def multiply_blocks(a: DataFrame, b: DataFrame, size: int = 1024) -> DataFrame:
    """Products of block pairs in Arrow batches, then sums of the partial blocks of a cell."""
    x, y = a.toDF("bi", "k", "x"), b.toDF("k", "bj", "y")

    def products(frames):
        for pdf in frames:
            out = [(np.frombuffer(p).reshape(size, size) @ np.frombuffer(q).reshape(size, size)).tobytes() for p, q in zip(pdf.x, pdf.y, strict=True)]
            yield pd.DataFrame({"bi": pdf.bi, "bj": pdf.bj, "block": out})

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block = sum(np.frombuffer(p) for p in pdf.block)
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "block": [block.tobytes()]})

    parts = x.join(y, "k").select("bi", "bj", "x", "y").mapInPandas(products, "bi long, bj long, block binary")
    return parts.groupBy("bi", "bj").applyInPandas(total, "bi long, bj long, block binary")


def from_blocks(m: DataFrame, size: int = 1024) -> DataFrame:
    def cells(frames):
        for pdf in frames:
            for bi, bj, raw in zip(pdf.bi, pdf.bj, pdf.block, strict=True):
                block = np.frombuffer(raw).reshape(size, size)
                r, c = np.nonzero(block)
                yield pd.DataFrame({"i": r + bi * size, "j": c + bj * size, "value": block[r, c]})

    return m.mapInPandas(cells, "i long, j long, value double")


def gramian(rows: DataFrame, v: str, size: int) -> DataFrame:
    """(i, j, value) of the upper triangle of X'X for dense rows of ``size`` components: partial
    sums of outer products, one array of size * size numbers for each task."""

    def run(frames):
        total = np.zeros((size, size))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf[v].to_numpy()).astype(float)
                total += x.T @ x
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    return rows.select(v).mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def cosine_similarities(entries: DataFrame) -> DataFrame:
    """(i, j, value), i < j, of the columns of coordinate entries, exact."""
    norms = entries.groupBy("j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    unit = entries.join(norms, "j").select("i", "j", (F.col("value") / F.col("n")).alias("u"))
    a, b = unit.toDF("r", "i", "a"), unit.toDF("r", "j", "b")
    return a.join(b, "r").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def sampled_similarities(entries: DataFrame, gamma: float, seed: int = 1) -> DataFrame:
    """Estimated similarities: entries of heavy columns are sampled in proportion to gamma / norm."""
    from orrery.operators.tuning import uniform

    norms = entries.groupBy("j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    e = entries.join(norms, "j").withColumn("p", F.least(F.lit(1.0), F.lit(gamma ** 0.5) / F.col("n")))
    e = e.where(uniform(seed, "i", "j") < F.col("p")).select("i", "j", (F.col("value") / F.least(F.lit(gamma ** 0.5), F.col("n"))).alias("u"))
    a, b = e.toDF("r", "i", "a"), e.toDF("r", "j", "b")
    return a.join(b, "r").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def _square(cells: DataFrame, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for r in cells.collect():  # size * (size + 1) / 2 numbers
        m[r.i, r.j] = m[r.j, r.i] = r.value
    return m


def svd(rows: DataFrame, v: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) from the Gramian; the left vectors are rows times V / s."""
    values, axes = np.linalg.eigh(_square(gramian(rows, v, size), size))
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), axes[:, order]


def pca(rows: DataFrame, v: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, share of the variance explained by each)."""
    n = rows.count()
    mean = np.array([r.m for r in sorted(rows.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect(), key=lambda r: r.i)])
    cov = (_square(gramian(rows, v, size), size) - n * np.outer(mean, mean)) / (n - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return axes[:, order], values[order] / values.sum()


def qr(rows: DataFrame, v: str, size: int) -> np.ndarray:
    """R of a tall, skinny matrix: local factors, factored once more; Q is rows times R^-1."""

    def run(frames):
        r = np.zeros((0, size))
        for pdf in frames:
            if len(pdf):
                r = np.linalg.qr(np.vstack((r, np.stack(pdf[v].to_numpy()).astype(float))), mode="r")
        yield pd.DataFrame({"r": [r.tobytes()]})

    parts = [np.frombuffer(x.r).reshape(-1, size) for x in rows.select(v).mapInPandas(run, "r binary").collect()]
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def project(df: DataFrame, v: str, axes: np.ndarray, output: str) -> DataFrame:
    basis = F.array(*[F.array(*[F.lit(float(x)) for x in column]) for column in axes.T])
    dot = lambda b: F.aggregate(F.zip_with(v, b, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(output, F.transform(basis, dot))


def random_columns(spark: SparkSession, n: int, kind: str, seed: int, parts: int | None = None, **p: float) -> DataFrame:
    """(id, value): uniform, normal, exponential, lognormal, weibull by inverse distribution
    functions of a hash; poisson and gamma by seeded generators for each block of ids."""
    from orrery.operators.tuning import uniform

    ids = spark.range(0, n, 1, parts) if parts else spark.range(n)
    u = uniform(seed, "id")
    gauss = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, "id"))
    made: dict[str, Column] = {
        "uniform": p.get("low", 0.0) + u * (p.get("high", 1.0) - p.get("low", 0.0)),
        "normal": p.get("mean", 0.0) + gauss * p.get("std", 1.0),
        "exponential": -F.log(1 - u) * p.get("mean", 1.0),
        "lognormal": F.exp(p.get("mean", 0.0) + gauss * p.get("std", 1.0)),
        "weibull": p.get("beta", 1.0) * F.pow(-F.log(1 - u), F.lit(1.0 / p.get("alpha", 1.0))),
    }
    if kind in made:
        return ids.select("id", made[kind].alias("value"))

    def run(frames):
        for pdf in frames:
            rng = [np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, int(i)]))) for i in pdf.id]
            x = [r.poisson(p.get("mean", 1.0)) if kind == "poisson" else r.gamma(p.get("shape", 1.0), p.get("scale", 1.0)) for r in rng]
            yield pd.DataFrame({"id": pdf.id, "value": np.array(x, float)})

    if kind not in ("poisson", "gamma"):
        raise ValueError(f"unknown distribution {kind}")
    return ids.mapInPandas(run, "id long, value double")


def linear_data(spark: SparkSession, n: int, weights: list[float], intercept: float, noise: float, seed: int) -> DataFrame:
    """(id, features, label) with uniform features in [-1, 1) and normal noise."""
    from orrery.operators.tuning import uniform

    x = F.array(*[uniform(seed + k, "id") * 2 - 1 for k in range(len(weights))])
    e = random_columns(spark, n, "normal", seed + 10_007, std=noise).withColumnRenamed("value", "e")
    dot = F.aggregate(F.zip_with("features", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(float(intercept)), lambda a, y: a + y)
    return e.withColumn("features", x).select("id", "features", (dot + F.col("e")).alias("label"))


def kmeans(df: DataFrame, features: str, k: int, rounds: int = 10, seed: int = 1, start: list[list[float]] | None = None) -> tuple[list[list[float]], list[float]]:
    """(centres, cost of each round): assignment is an expression over the centres as a literal,
    update one grouped sum. Without ``start``, the centres begin at k rows drawn by a seeded hash."""
    if start is None:
        start = [r[0] for r in df.orderBy(F.xxhash64(F.lit(seed), features)).limit(k).select(features).collect()]
    centres = [[float(x) for x in c] for c in start]
    history = []
    for _ in range(rounds):
        a = assigned(df, features, centres)
        history.append(a.agg(F.sum("cost")).first()[0])
        means = a.select("cluster", F.posexplode(features).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).collect()  # k * size numbers
        new = [list(c) for c in centres]
        for r in means:
            new[r.cluster][r.i] = r.m
        if new == centres:
            break
        centres = new
    return centres, history


def assigned(df: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    cost = F.transform(table, lambda c: F.aggregate(F.zip_with(features, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return df.withColumn("__c", cost).withColumn("cost", F.array_min("__c")).withColumn("cluster", F.array_position("__c", F.col("cost")).cast("int") - 1).drop("__c")
