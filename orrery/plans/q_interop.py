"""Queries of the exchange with Spark's ML columns, of line parsers and of model sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import interop
from orrery.operators.statistics import active_features, partition_rows
from orrery.plans.registry import query
from orrery.sources import examples

KEYS = ("l_orderkey", "l_linenumber")
_X = ("l_quantity", "l_discount", "l_tax")


@query("ml_vectors", "SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS x1, l_tax AS x2, CAST((l_quantity <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT AS INTEGER) AS nnz, CAST(3 AS BIGINT) AS size FROM lineitem")
def _(t, spark):
    """Dense to stock vectors and back, as arrays and as sparse structs."""
    df = t("lineitem").select(*KEYS, V.dense(*_X).alias("v"))
    stock = interop.to_ml(df, "v").withColumn("s", F.col("v"))
    back = interop.from_ml(interop.from_ml(stock, "s"), "v", dense=True)
    return back.select(*KEYS, *[F.get("v", k).alias(f"x{k}") for k in range(3)], F.size("s.indices").alias("nnz"), F.col("s.size").alias("size"))


@query("ml_sparse_vectors", """SELECT o_orderkey, CAST(1 + (o_custkey % 3 <> 0)::INT AS INTEGER) AS nnz, CAST(10 + CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 ELSE 0 END AS BIGINT) AS indices,
  o_totalprice + CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 ELSE 0 END AS total FROM orders""")
def _(t, spark):
    k = (F.col("o_custkey") % 3).cast("long")
    i = F.when(k != 0, F.array(k, F.lit(10).cast("long"))).otherwise(F.array(F.lit(10).cast("long")))
    x = F.when(k != 0, F.array(k.cast("double"), F.col("o_totalprice"))).otherwise(F.array(F.col("o_totalprice")))
    df = t("orders").select("o_orderkey", F.struct(F.lit(20).cast("long").alias("size"), i.alias("indices"), x.alias("values")).alias("v"))
    back = interop.from_ml(interop.to_ml(df, "v"), "v")
    return back.select("o_orderkey", F.size("v.indices").alias("nnz"), F.aggregate("v.indices", F.lit(0).cast("long"), lambda a, b: a + b).alias("indices"), V.total(F.col("v.values")).alias("total"))


@query("ml_matrices", "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_discount AS c, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem")
def _(t, spark):
    rows = F.array(F.array("l_quantity", "l_tax"), F.array(F.col("l_discount"), F.col("l_linenumber").cast("double")))
    m = interop.matrix_from_ml(interop.matrix_to_ml(t("lineitem").select(*KEYS, rows.alias("m")), "m"), "m")
    at = lambda i, j: F.get(F.get("m", i), j)
    return m.select(*KEYS, at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d"))


@query("attribute_rewriter", "SELECT CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS idx, 'flag=' || l_returnflag AS name FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def _(t, spark):
    """Attributes named after the return flags, renamed."""
    flags = [r[0] for r in t("lineitem").select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    v = F.array(*[(F.col("l_returnflag") == f).cast("double") for f in flags])
    df = t("lineitem").select("l_orderkey", interop.named_attributes(v, "f", [f"onehot_1:{f}" for f in flags]))
    out = interop.AttributeRewriter(input="f", prefixes={"onehot": "flag", "_1:": "="}).transform(df)
    return spark.createDataFrame(list(enumerate(interop.attribute_names(out, "f"))), "idx int, name string")


def _lines(t, dummy: bool = False) -> DataFrame:
    o = t("orders")
    price = F.concat(F.lit("12:"), F.col("o_totalprice").cast("string"))
    items = ["o_custkey", F.lit(3)] if dummy else [F.concat("o_custkey", F.lit(":0.5")), price]
    return o.select("o_orderkey", "o_custkey", F.concat_ws(" ", (F.col("o_orderkey") % 2).cast("string"), *items).alias("line"))


@query("ftrl_lines", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS label, CAST(o_orderkey % 2 AS DOUBLE) AS plain, CAST(o_custkey + 12 AS BIGINT) AS keys, round(o_totalprice + 0.5, 2) AS total FROM orders")
def _(t, spark):
    p = examples.parse_example(F.col("line"), 1 << 40)
    df = _lines(t).select("o_orderkey", examples.parse_label(F.col("line"), True).alias("label"), p.alias("p"))
    return df.select("o_orderkey", "label", F.col("p.label").alias("plain"), F.aggregate("p.features.indices", F.lit(0).cast("long"), lambda a, b: a + b).alias("keys"), F.round(V.total(F.col("p.features.values")), 2).alias("total"))


@query("ftrl_dummy_lines", "SELECT o_orderkey, CAST(o_orderkey % 2 AS VARCHAR) AS attached, CAST(o_custkey + 3 AS BIGINT) AS keys, CASE WHEN o_custkey = 0 THEN 2.0 ELSE 3.0 END::DOUBLE AS total FROM orders")
def _(t, spark):
    """Lines to be scored: the first item is carried along, a bias is appended."""
    p = examples.parse_example(F.col("line"), 1 << 20, "int", "dummy", training=False)
    df = _lines(t, dummy=True).select("o_orderkey", p.alias("p")).withColumn("v", examples.append_bias(F.col("p.features")))
    return df.select("o_orderkey", F.col("p.attached").alias("attached"), F.aggregate("v.indices", F.lit(0).cast("long"), lambda a, b: a + b).alias("keys"), V.total(F.col("v.values")).alias("total"))


@query("model_size", "SELECT count(DISTINCT l_partkey) AS active, count(*) AS rows FROM lineitem")
def _(t, spark):
    v = F.struct(F.lit(1 << 40).cast("long").alias("size"), F.array(F.col("l_partkey").cast("long")).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    return active_features(t("lineitem").select(v.alias("features")))


@query("partition_rows", "SELECT count(*) AS rows FROM lineitem")
def _(t, spark):
    return partition_rows(t("lineitem")).agg(F.sum("rows").alias("rows"))
