"""Transformers of vector columns (``array<double>``): assembly, scaling, expansion, selection."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators.scalar import indicator
from orrery.operators.stage import Fitter, Stage, checked_policy


class VectorAssembler(Stage):
    """Numbers, booleans and vectors side by side; null and NaN raise, drop the row, or stay as NaN."""

    params = {"inputs": [], "output": "features", "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        policy = checked_policy(self.handle_invalid)
        kinds, parts = dict(df.dtypes), []
        for c in self.inputs:
            if kinds[c].startswith("array"):
                parts.append(F.transform(c, lambda x: x.cast("double")))
            elif kinds[c].startswith("struct"):
                parts.append(V.to_dense(F.col(c)))
            else:
                parts.append(F.array(F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).cast("double")))
        if policy == "skip":
            for p in parts:
                df = df.where(p.isNotNull() & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x)))
        fixed = {"keep": lambda x: F.coalesce(x, F.lit(math.nan)), "skip": lambda x: x}
        fixed["error"] = lambda x: F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.raise_error(F.lit("null or NaN in an assembled column")).cast("double"))
        return df.withColumn(self.output, F.transform(F.concat(*parts), fixed[policy]))


class VectorSlicer(Stage):
    """Components by index, in the given order."""

    params = {"input": "features", "output": "sliced", "indices": [], "names": []}

    def apply(self, df: DataFrame) -> DataFrame:
        known = [a["name"] for a in df.schema[self.input].metadata.get("ml_attr", {}).get("attrs", [])]
        picks = [*self.indices, *[known.index(n) for n in self.names]]
        if not picks or len(set(picks)) < len(picks):
            raise ValueError("at least one index, none twice")
        return df.withColumn(self.output, F.array(*[F.element_at(self.input, int(i) + 1) for i in picks]))


class VectorSizeHint(Stage):
    params = {"input": "features", "size": 1, "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        policy = checked_policy(self.handle_invalid, ("error", "skip", "optimistic"))
        fits = F.coalesce(F.size(self.input) == self.size, F.lit(False))
        if policy == "skip":
            df = df.where(fits)
        v = F.col(self.input)
        if policy == "error":
            v = F.when(fits, v).otherwise(F.raise_error(F.lit(f"vector without {self.size} components")).cast("array<double>"))
        return df.withColumn(self.input, v.alias(self.input, metadata={"ml_attr": {"num_attrs": self.size}}))


class Normalizer(Stage):
    params = {"input": "features", "output": "normalized", "p": 2.0}

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__norm", V.norm(F.col(self.input), float(self.p)))
        v = F.when(F.col("__norm") == 0, F.col(self.input)).otherwise(F.transform(self.input, lambda x: x / F.col("__norm")))
        return df.withColumn(self.output, v).drop("__norm")


class ElementwiseProduct(Stage):
    params = {"input": "features", "output": "product", "scaling": []}

    def apply(self, df: DataFrame) -> DataFrame:
        by = F.array(*[F.lit(float(x)) for x in self.scaling])
        v = F.when(F.size(self.input) == len(self.scaling), F.zip_with(self.input, by, lambda x, y: x * y))
        return df.withColumn(self.output, v.otherwise(F.raise_error(F.lit("vector of another size")).cast("array<double>")))


class PolynomialExpansion(Stage):
    """All monomials up to ``degree`` of vectors of ``size`` components, in the order of the
    recursion on the last variable: x, x^2, y, xy, y^2, ..."""

    params = {"input": "features", "output": "expanded", "degree": 2, "size": 2}

    def terms(self) -> list[tuple[int, ...]]:
        def expand(last: int, degree: int) -> list[tuple[int, ...]]:
            # monomials in variables 0..last of at most this degree, without the constant's own place
            if last < 0 or degree == 0:
                return [()]
            return [t + (last,) * k for k in range(degree + 1) for t in expand(last - 1, degree - k)]

        return [t for t in expand(self.size - 1, self.degree) if t]

    def apply(self, df: DataFrame) -> DataFrame:
        def product(t: tuple[int, ...]) -> Column:
            out = F.element_at(self.input, t[0] + 1)
            for i in t[1:]:
                out = out * F.element_at(self.input, i + 1)
            return out

        return df.withColumn(self.output, F.array(*[product(t) for t in self.terms()]))


def _outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


class Interaction(Stage):
    """Products over columns: each column is a number, a vector, or (``levels``) a category index
    of so many levels; the first column is the most significant."""

    params = {"inputs": [], "output": "interaction", "levels": {}}

    def apply(self, df: DataFrame) -> DataFrame:
        kinds, out = dict(df.dtypes), None
        for c in self.inputs:
            if c in self.levels:
                v = indicator(F.col(c).cast("int"), self.levels[c])
            elif kinds[c].startswith("array"):
                v = F.transform(c, lambda x: x.cast("double"))
            else:
                v = F.array(F.col(c).cast("double"))
            out = v if out is None else _outer(out, v)
        return df.withColumn(self.output, out)


class DCT(Stage):
    """Orthonormal DCT-II of vectors of ``size`` components, or its inverse."""

    params = {"input": "features", "output": "dct", "size": 8, "inverse": False}

    def apply(self, df: DataFrame) -> DataFrame:
        n = self.size
        basis = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]
        if self.inverse:
            basis = [list(x) for x in zip(*basis, strict=True)]
        rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in basis])
        return df.withColumn(self.output, F.transform(rows, lambda r: V.dot(F.col(self.input), r)))


def component_stats(df: DataFrame, vector: str) -> DataFrame:
    """(idx, n, mean, std, min, max, max_abs, nnz) of each component, one row for each."""
    x = F.col("x")
    return df.select(F.posexplode(vector).alias("idx", "x")).groupBy("idx").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min(F.when(~F.isnan(x), x)).alias("min"),
        F.max(F.when(~F.isnan(x), x)).alias("max"),
        F.max(F.abs(F.when(~F.isnan(x), x))).alias("max_abs"),
        F.sum((x != 0).cast("long")).alias("nnz"),
    )


def _columns_of(df: DataFrame, vector: str, *names: str) -> list[list[float]]:
    rows = sorted(component_stats(df, vector).select("idx", *names).toLocalIterator(), key=lambda r: r.idx)
    return [[r[n] for r in rows] for n in names]


class AffineModel(Stage):
    """Each component: (x - shift) * factor + offset; ``fixed`` components become their value."""

    params = {"input": "features", "output": "scaled", "shift": [], "factor": [], "offset": [], "fixed": []}

    def apply(self, df: DataFrame) -> DataFrame:
        n = len(self.factor)
        fixed = self.fixed or [None] * n
        table = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in (("s", self.shift[i]), ("f", self.factor[i]), ("o", self.offset[i]))], F.lit(fixed[i]).cast("double").alias("c")) for i in range(n)])
        one = lambda x, t: F.when(t.c.isNotNull() & ~F.isnan(x), t.c).otherwise((x - t.s) * t.f + t.o)
        return df.withColumn(self.output, F.zip_with(self.input, table, one))


class StandardScaler(Fitter):
    """Zero mean (``with_mean``) and unit sample deviation (``with_std``); deviation 0 gives 0."""

    params = {"input": "features", "output": "scaled", "with_mean": False, "with_std": True}

    def learn(self, df: DataFrame) -> AffineModel:
        mean, std = _columns_of(df, self.input, "mean", "std")
        zero = [0.0] * len(mean)
        factor = [(1 / s if s else 0.0) if self.with_std else 1.0 for s in std]
        return AffineModel(input=self.input, output=self.output, shift=mean if self.with_mean else zero, factor=factor, offset=zero)


class MinMaxScaler(Fitter):
    """[min, max] of each component onto [low, high]; constant components get the middle, NaN stays."""

    params = {"input": "features", "output": "scaled", "low": 0.0, "high": 1.0}

    def learn(self, df: DataFrame) -> AffineModel:
        low, high = _columns_of(df, self.input, "min", "max")
        same = [a == b for a, b in zip(low, high, strict=True)]
        factor = [0.0 if s else (self.high - self.low) / (b - a) for a, b, s in zip(low, high, same, strict=True)]
        middle = (self.low + self.high) / 2
        return AffineModel(input=self.input, output=self.output, shift=low, factor=factor, offset=[self.low] * len(low), fixed=[middle if s else None for s in same])


class MaxAbsScaler(Fitter):
    params = {"input": "features", "output": "scaled"}

    def learn(self, df: DataFrame) -> AffineModel:
        (top,) = _columns_of(df, self.input, "max_abs")
        zero = [0.0] * len(top)
        return AffineModel(input=self.input, output=self.output, shift=zero, factor=[1 / t if t else 1.0 for t in top], offset=zero)


class VectorIndexerModel(Stage):
    params = {"input": "features", "output": "indexed", "categories": {}, "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        policy = checked_policy(self.handle_invalid)
        maps = {int(i): values for i, values in self.categories.items()}

        def one(x: Column, i: Column) -> Column:
            out = x
            for k, values in maps.items():
                new = F.array_position(F.array(*[F.lit(float(v)) for v in values]), x + 0.0).cast("double") - 1
                unseen = {"keep": F.lit(float(len(values))), "skip": F.lit(None).cast("double"), "error": F.raise_error(F.lit("unseen category")).cast("double")}[policy]
                out = F.when(i == k, F.when(new >= 0, new).otherwise(unseen)).otherwise(out)
            return out

        df = df.withColumn(self.output, F.transform(self.input, one))
        return df.where(F.forall(self.output, lambda x: x.isNotNull())) if policy == "skip" else df


class VectorIndexer(Fitter):
    """Components of at most ``max_categories`` values become category indexes: zero first, the
    others ascending."""

    params = {"input": "features", "output": "indexed", "max_categories": 20, "handle_invalid": "error"}

    def learn(self, df: DataFrame) -> VectorIndexerModel:
        pairs = df.select(F.posexplode(self.input).alias("idx", "x")).distinct()
        few = pairs.groupBy("idx").agg(F.count("*").alias("n")).where(F.col("n") <= self.max_categories).select("idx")
        values: dict[int, list[float]] = {}
        for r in pairs.join(few, "idx", "left_semi").toLocalIterator():
            values.setdefault(r.idx, []).append(r.x + 0.0)
        return VectorIndexerModel(
            input=self.input, output=self.output, handle_invalid=self.handle_invalid,
            categories={str(i): sorted(set(v), key=lambda x: (x != 0, x)) for i, v in sorted(values.items())},
        )


def feature_hash(columns: dict[str, str], size: int = 1 << 18, categorical: tuple[str, ...] = ()) -> Column:
    """Sparse vector of hashed columns (name -> type): numbers at hash(name) with their value,
    strings, booleans and ``categorical`` ones at hash("name=value") with 1; nulls are left out and
    collisions add up. Indexes are pmod(murmur3(term), size)."""
    entries = []
    for name, kind in columns.items():
        x = F.col(name)
        if kind in ("string", "boolean") or name in categorical:
            term, value = F.concat(F.lit(f"{name}="), x.cast("string")), F.lit(1.0)
        else:
            term, value = F.lit(name), x.cast("double")
        entries.append(F.when(x.isNotNull(), F.struct(F.pmod(F.hash(term), F.lit(size)).cast("long").alias("i"), value.alias("x"))))
    return merged(F.filter(F.array(*entries), lambda e: e.isNotNull()), size)


def merged(entries: Column, size: int) -> Column:
    """A sparse vector from (i, x) entries; entries of one index add up. One sort, then one pass."""

    def runs(e: Column) -> Column:
        n = F.size(e)
        at = lambda k: F.get(e, k)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (at(k - 1).i != at(k).i))
        return V.let(F.when(n > 0, starts).otherwise(F.array().cast("array<int>")), lambda s: F.struct(
            F.lit(size).cast("long").alias("size"),
            F.transform(s, lambda k: at(k).i).alias("indices"),
            F.transform(s, lambda k, j: F.aggregate(F.sequence(k, F.coalesce(F.get(s, j + 1), n) - 1), F.lit(0.0), lambda a, m: a + at(m).x)).alias("values"),
        ))

    return V.let(F.array_sort(entries), runs)


class FeatureHasher(Stage):
    params = {"inputs": [], "output": "features", "size": 1 << 18, "categorical": []}

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.withColumn(self.output, feature_hash({c: kinds[c] for c in self.inputs}, self.size, tuple(self.categorical)))


class ChiSqSelector(Fitter):
    """Components by their chi-square test against the label: the ``top`` best, the best
    ``percentile``, or p-values below fpr, fdr (Benjamini-Hochberg) or fwe."""

    params = {"input": "features", "output": "selected", "label": "label", "kind": "top", "top": 50, "percentile": 0.1, "alpha": 0.05}

    def learn(self, df: DataFrame) -> VectorSlicer:
        from orrery.operators.statistics import chi_square_by_feature

        found = sorted(((r.p_value, -r.statistic / max(r.df, 1), r.idx) for r in chi_square_by_feature(df, self.input, self.label).toLocalIterator()))
        n = len(found)
        if self.kind == "top":
            kept = found[: self.top]
        elif self.kind == "percentile":
            kept = found[: int(n * self.percentile)]
        elif self.kind == "fpr":
            kept = [x for x in found if x[0] < self.alpha]
        elif self.kind == "fwe":
            kept = [x for x in found if x[0] < self.alpha / n]
        elif self.kind == "fdr":
            last = max((k for k, x in enumerate(found, 1) if x[0] <= self.alpha * k / n), default=0)
            kept = found[:last]
        else:
            raise ValueError(f"unknown kind {self.kind}")
        return VectorSlicer(input=self.input, output=self.output, indices=sorted(x[2] for x in kept))


def monomials(size: int, degree: int) -> int:
    """Number of terms of a polynomial expansion."""
    return sum(1 for d in range(1, degree + 1) for _ in combinations_with_replacement(range(size), d))
