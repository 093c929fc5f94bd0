"""Lines of online learners: ``label key:value ...`` or ``label key ...`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYS = {"int": "int", "long": "bigint"}


def parse_example(line: Column, size: int, key: str = "long", value: str = "double", training: bool = True, labelled: bool = True) -> Column:
    """(label, attached, features) of a line; null for null. ``key`` is int or long, ``value`` double, float or
    dummy (keys alone, each 1). A labelled line begins with its label; outside training that first item is
    carried along as ``attached`` text instead, and the label is NaN, as it is for lines without one. Keys are
    taken as written, in any order; what isn't a number is an error."""
    if key not in _KEYS or value not in ("double", "float", "dummy"):
        raise ValueError(f"no lines of {key} keys and {value} values")
    items = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    first = F.get(items, 0)
    entries = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))) if labelled else items
    pair = lambda x: F.split(x, ":")
    indices = F.transform(entries, lambda x: F.get(pair(x), 0).cast(_KEYS[key]).cast("bigint"))
    number = lambda x: F.get(pair(x), 1).cast("float" if value == "float" else "double").cast("double")
    values = F.transform(entries, lambda x: F.lit(1.0) if value == "dummy" else number(x))
    label = first.cast("double") if labelled and training else F.lit(float("nan"))
    attached = first if labelled and not training else F.lit("")
    v = F.struct(F.lit(size).cast("long").alias("size"), indices.alias("indices"), values.alias("values"))
    return F.when(line.isNotNull(), F.struct(label.alias("label"), attached.alias("attached"), v.alias("features")))


def parse_label(line: Column, negative: bool | None = None) -> Column:
    """The first item of a line: as text, or as a number whose negative class is -1 (``negative``) or 0."""
    first = F.get(F.split(F.trim(line), " "), 0)
    if negative is None:
        return first
    y = first.cast("double")
    return F.when(y == (0.0 if negative else -1.0), F.lit(-1.0 if negative else 0.0)).otherwise(y)


def append_bias(v: Column) -> Column:
    """A sparse vector whose component 0 is 1, whatever it was."""
    others = F.filter(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")), lambda e: e.i != 0)
    return F.struct(
        v["size"].alias("size"),
        F.array_prepend(F.transform(others, lambda e: e.i), F.lit(0).cast("long")).alias("indices"),
        F.array_prepend(F.transform(others, lambda e: e.x), F.lit(1.0)).alias("values"),
    )
