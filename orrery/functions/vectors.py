"""Vectors as Spark columns.

Dense vectors are ``array<double>``. Sparse vectors are ``struct<size:bigint, indices:array<bigint>,
values:array<double>>``, so they may be longer than a 32-bit index. The long form of a frame has one
row (row_id, idx, value) for each stored entry. All builders here are expressions without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE = "struct<size:bigint,indices:array<bigint>,values:array<double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def dense(*columns: Column | str) -> Column:
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns])


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def to_dense(v: Column, size: Column | None = None) -> Column:
    """A sparse vector as an array."""
    n = (size if size is not None else v["size"]).cast("int")
    place = F.map_from_arrays(v["indices"], v["values"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(place, i.cast("long")), F.lit(0.0)))


def to_sparse(v: Column) -> Column:
    """A dense vector without its zeros."""
    entries = F.filter(F.transform(v, lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x"))), lambda e: e.x != 0.0)
    return F.struct(
        F.size(v).cast("long").alias("size"),
        F.transform(entries, lambda e: e.i).alias("indices"),
        F.transform(entries, lambda e: e.x).alias("values"),
    )


def compressed_is_sparse(v: Column) -> Column:
    """Whether the sparse form of a dense vector is the smaller one: 1.5 * (nonzeros + 1) < size."""
    return F.lit(1.5) * (F.size(F.filter(v, lambda x: x != 0.0)) + 1) < F.size(v)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by) -> Column:
    return F.transform(v, lambda x: x * by)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sparse_dot(v: Column, w: Column) -> Column:
    """Inner product of a sparse vector with a dense one."""
    return total(F.zip_with(v["values"], v["indices"], lambda x, i: x * F.element_at(w, (i + 1).cast("int"))))


def norm(v: Column, p: float = 2.0) -> Column:
    if p < 1:
        raise ValueError("p is at least 1")
    if p == float("inf"):
        return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
    if p == 1.0:
        return total(F.transform(v, F.abs))
    if p == 2.0:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def long_form(df: DataFrame, vector: str, row_id: str, *keep: str) -> DataFrame:
    """(row_id, *keep, idx, value) of a dense vector column."""
    return df.select(F.col(row_id).alias("row_id"), *keep, F.posexplode(vector).alias("idx", "value"))


def from_long(df: DataFrame, size: int | None = None) -> DataFrame:
    """(row_id, vector) from (row_id, idx, value): sparse, entries in ascending order, repeated
    indexes added up."""
    summed = df.groupBy("row_id", "idx").agg(F.sum("value").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("i"), F.col("value").alias("x"))))
    rows = summed.groupBy("row_id").agg(entries.alias("e"), (F.max("idx") + 1).alias("n"))
    return rows.select(
        "row_id",
        F.struct(
            (F.lit(size) if size else F.col("n")).cast("long").alias("size"),
            F.transform("e", lambda e: e.i).alias("indices"),
            F.transform("e", lambda e: e.x).alias("values"),
        ).alias("vector"),
    )


def parse(text: Column) -> Column:
    """Sparse vectors from ``[v, ...]`` or ``(size,[i, ...],[v, ...])``."""
    numbers = lambda x, t: F.transform(F.filter(F.split(x, r"\s*,\s*"), lambda y: F.trim(y) != ""), lambda y: F.trim(y).cast(t))
    plain = numbers(F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1), "double")
    pattern = r"^\s*\(\s*(\d+)\s*,\s*\[(.*?)\]\s*,\s*\[(.*?)\]\s*\)\s*$"
    sparse = F.struct(
        F.regexp_extract(text, pattern, 1).try_cast("bigint").alias("size"),
        numbers(F.regexp_extract(text, pattern, 2), "bigint").alias("indices"),
        numbers(F.regexp_extract(text, pattern, 3), "double").alias("values"),
    )
    full = F.struct(
        F.size(plain).cast("long").alias("size"),
        F.transform(plain, lambda x, i: i.cast("long")).alias("indices"),
        plain.alias("values"),
    )
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), full).otherwise(sparse)


def show(v: Column) -> Column:
    """The text that ``parse`` reads, in sparse form."""
    return F.concat(
        F.lit("("), v["size"].cast("string"), F.lit(",["), F.array_join(F.transform(v["indices"], lambda i: i.cast("string")), ","),
        F.lit("],["), F.array_join(F.transform(v["values"], lambda x: x.cast("string")), ","), F.lit("])"),
    )
