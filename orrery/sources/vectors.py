"""The libsvm, field-aware (ffm) and one-hot (dummy) text formats.

Readers parse lines with column expressions: blank lines and lines that begin with ``#`` are left
out, and columns that a query doesn't use are never parsed. Vectors are sparse structs with 64-bit
indexes (``functions.vectors.SPARSE``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    return spark.read.text(path).select(line.alias("line")).where((line != "") & ~F.startswith(line, F.lit("#")))


def _items(separator: str = r"\s+") -> tuple[Column, Column]:
    parts = F.filter(F.split("line", separator), lambda x: x != "")
    return F.get(parts, 0).cast("double"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _ascending(indices: Column) -> Column:
    pairs = F.zip_with(indices, F.slice(indices, 2, F.greatest(F.size(indices) - 1, F.lit(0))), lambda a, b: b.isNull() | (a < b))
    return F.forall(pairs, lambda ok: ok)


def _vector(size: Column, indices: Column, values: Column, ordered: bool) -> Column:
    v = F.struct(size.cast("long").alias("size"), indices.alias("indices"), values.alias("values"))
    if not ordered:
        return v
    return F.when(_ascending(indices), v).otherwise(F.raise_error(F.lit("indices must ascend")).cast(V.SPARSE))


def width_of(df: DataFrame, indices: Column) -> int:
    """Largest index + 1: a pass over the file, left out where ``num_features`` is given."""
    return int(df.agg(F.coalesce(F.max(F.array_max(indices)) + 1, F.lit(0))).first()[0])


def _read(df: DataFrame, label: Column, indices: Column, values: Column, num_features: int, vector_type: str, ordered: bool) -> DataFrame:
    if vector_type not in ("sparse", "dense"):
        raise ValueError(f"vector type is sparse or dense, not {vector_type!r}")
    n = num_features if num_features > 0 else width_of(df, indices)
    v = _vector(F.lit(n), indices, values, ordered)
    return df.select(label.alias("label"), (V.to_dense(v) if vector_type == "dense" else v).alias("features", metadata={"numFeatures": n}))


def read_libsvm(spark: SparkSession, path: str, num_features: int = -1, vector_type: str = "sparse", one_based: bool = True, separator: str = r"\s+") -> DataFrame:
    """(label, features) from ``label i:v ...``; indexes count from 1 and strictly ascend."""
    label, items = _items(separator)
    pair = F.transform(items, lambda x: F.split(x, ":"))
    indices = F.transform(pair, lambda p: F.get(p, 0).cast("bigint") - (1 if one_based else 0))
    return _read(_lines(spark, path), label, indices, F.transform(pair, lambda p: F.get(p, 1).cast("double")), num_features, vector_type, True)


def libsvm_line(label: Column, v: Column, one_based: bool = True) -> Column:
    shift = 1 if one_based else 0
    entries = F.zip_with(v["indices"], v["values"], lambda i, x: F.concat((i + shift).cast("string"), F.lit(":"), x.cast("string")))
    return F.concat_ws(" ", F.array_prepend(entries, label.cast("double").cast("string")))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    df.select(libsvm_line(F.col(label), F.col(features)).alias("value")).write.mode("overwrite").text(path)


def read_gbdt_libsvm(spark: SparkSession, path: str, num_features: int = -1) -> DataFrame:
    """Separators are white space or commas, indexes are taken as written."""
    return read_libsvm(spark, path, num_features, one_based=False, separator=r"[\s,]+")


def read_ffm(spark: SparkSession, path: str, num_features: int = -1) -> DataFrame:
    """(label, features, fields) from ``label field:key:value ...``: keys are not shifted, and
    ``fields`` has the field of each entry."""
    label, items = _items()
    part = F.transform(items, lambda x: F.split(x, ":"))
    at = lambda k, t: F.transform(part, lambda p: F.get(p, k).cast(t))
    df = _lines(spark, path)
    n = num_features if num_features > 0 else width_of(df, at(1, "bigint"))
    v = _vector(F.lit(n), at(1, "bigint"), at(2, "double"), False)
    return df.select(label.alias("label"), v.alias("features", metadata={"numFeatures": n}), at(0, "bigint").alias("fields"))


def ffm_metadata(df: DataFrame) -> DataFrame:
    """(key, field) of each key; a key of several fields has its largest."""
    e = F.explode(F.arrays_zip(F.col("features.indices").alias("key"), F.col("fields").alias("field")))
    return df.select(e.alias("e")).groupBy(F.col("e.key").alias("key")).agg(F.max("e.field").alias("field"))


def write_ffm(df: DataFrame, path: str) -> None:
    entries = F.transform(F.arrays_zip(F.col("fields").alias("f"), F.col("features.indices").alias("i"), F.col("features.values").alias("x")), lambda e: F.concat_ws(":", e.f.cast("string"), e.i.cast("string"), e.x.cast("string")))
    df.select(F.concat_ws(" ", F.array_prepend(entries, F.col("label").cast("string"))).alias("value")).write.mode("overwrite").text(path)


def read_dummy(spark: SparkSession, path: str, num_features: int = -1, vector_type: str = "sparse") -> DataFrame:
    """(label, features) from ``label k1 k2 ...``: keys count from 0 and ascend, values are 1."""
    label, items = _items()
    indices = F.transform(items, lambda x: x.cast("bigint"))
    return _read(_lines(spark, path), label, indices, F.transform(items, lambda x: F.lit(1.0)), num_features, vector_type, True)


def write_dummy(df: DataFrame, path: str) -> None:
    keys = F.transform(F.col("features.indices"), lambda i: i.cast("string"))
    df.select(F.concat_ws(" ", F.array_prepend(keys, F.col("label").cast("string"))).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(features) from lines in the form of ``functions.vectors.parse``."""
    return _lines(spark, path).select(V.parse(F.col("line")).alias("features"))


def read_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """(label, features) from ``(label,vector)`` or ``label,x x ...`` lines."""
    pair = r"^\(\s*([^,\[\(]+)\s*,\s*(.*)\)$"
    own = F.regexp_extract("line", pair, 1)
    plain = F.concat(F.lit("["), F.regexp_replace(F.regexp_extract("line", r"^[^,]*,(.*)$", 1), r"\s+", ","), F.lit("]"))
    is_pair = F.startswith("line", F.lit("("))
    label = F.when(is_pair, own).otherwise(F.regexp_extract("line", r"^([^,]*),", 1))
    return _lines(spark, path).select(label.cast("double").alias("label"), V.parse(F.when(is_pair, F.regexp_extract("line", pair, 2)).otherwise(plain)).alias("features"))


def register_formats(spark: SparkSession) -> None:
    """``spark.read.format("libsvmex" | "libffm" | "dummy")`` for drop-in use; the functions above
    are the faster way, as they stay in the JVM."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    readers = {"libsvmex": read_libsvm, "libffm": read_ffm, "dummy": read_dummy}
    fields = "label double, indices array<bigint>, values array<double>"

    def parse(kind: str, line: str):
        parts = line.split()
        if kind == "dummy":
            keys = [int(p) for p in parts[1:]]
            return float(parts[0]), keys, [1.0] * len(keys)
        split = [p.split(":") for p in parts[1:]]
        shift = 1 if kind == "libsvmex" else 0
        return float(parts[0]), [int(p[-2]) - shift for p in split], [float(p[-1]) for p in split]

    for kind in readers:

        class Reader(DataSourceReader):
            def __init__(self, path: str, kind: str = kind) -> None:
                self.path, self.kind = path, kind

            def read(self, partition):
                from pyarrow import fs

                uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
                store, root = fs.FileSystem.from_uri(uri)
                info = store.get_file_info(root)
                files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))]
                for f in files:
                    for line in store.open_input_stream(f.path).read().decode().splitlines():
                        if line.strip() and not line.lstrip().startswith("#"):
                            yield parse(self.kind, line)

        class Source(DataSource):
            _kind, _reader = kind, Reader

            @classmethod
            def name(cls):
                return cls._kind

            def schema(self):
                return fields

            def reader(self, schema):
                return self._reader(self.options["path"])

        spark.dataSource.register(Source)
