"""Edge lists and embedding tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str, sep: str = " ", src: int = 0, dst: int = 1, weight: int | None = None) -> DataFrame:
    """(src long, dst long, weight float): columns by their place in the line, weight 1 without one."""
    parts = F.split("value", F.lit("[" + sep + "]+") if sep.strip() == "" else F.lit(sep))
    w = F.get(parts, weight).cast("float") if weight is not None else F.lit(1.0).cast("float")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.get(parts, src).cast("long").alias("src"), F.get(parts, dst).cast("long").alias("dst"), w.alias("weight"))


def write_edges(df: DataFrame, path: str, sep: str = " ", *columns: str) -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns or df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_embedding(df: DataFrame, path: str, sep: str = ":", node: str = "node", vector: str = "vector") -> None:
    """``id<sep>x x x`` for each node."""
    numbers = F.array_join(F.transform(vector, lambda x: x.cast("float").cast("string")), " ")
    df.select(F.concat(F.col(node).cast("string"), F.lit(sep), numbers).alias("value")).write.mode("overwrite").text(path)


def read_embedding(spark: SparkSession, path: str, sep: str = ":") -> DataFrame:
    rows = spark.read.text(path)
    numbers = F.transform(F.split(F.regexp_extract("value", f"^[^{sep}]*{sep}(.*)$", 1), " "), lambda x: x.cast("float"))
    return rows.select(F.split("value", sep)[0].cast("long").alias("node"), numbers.alias("vector"))
