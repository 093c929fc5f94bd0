"""Queries of graph algorithms, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import graph as G
from orrery.plans.registry import query
from orrery.plans.storage import fresh_path
from orrery.sources import graphs, vectors

_EDGES = "SELECT DISTINCT l_partkey AS src, 1000000 + l_suppkey AS dst FROM lineitem"


def _edges(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()


_BOTH = f"e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("node_indexer", f"WITH e AS ({_EDGES}) SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")
def _(t, spark):
    return G.node_index(_edges(t))


def _k_core_sql(rounds: int) -> str:
    out = f"WITH {_BOTH}, c0 AS (SELECT src AS node, count(*) AS k FROM b GROUP BY src)"
    for i in range(rounds):
        out += f""", r{i} AS (SELECT b.src AS node, k, row_number() OVER (PARTITION BY b.src ORDER BY k DESC) AS r FROM b JOIN c{i} ON b.dst = c{i}.node),
          c{i + 1} AS (SELECT c{i}.node, least(c{i}.k, h) AS k FROM c{i} JOIN (SELECT node, sum((k >= r)::INT) AS h FROM r{i} GROUP BY node) USING (node))"""
    return out + f" SELECT node, CAST(k AS INTEGER) AS coreness FROM c{rounds}"


@query("kcore", _k_core_sql(8))
def _(t, spark):
    return G.k_core(_edges(t))


def _page_rank_sql(rounds: int) -> str:
    out = f"WITH e AS ({_EDGES}), l AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS s FROM e), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n)"
    for i in range(rounds):
        out += f""", g{i} AS (SELECT n.node, coalesce(sum(r{i}.rank * l.s), 0.0) AS got FROM n LEFT JOIN l ON l.dst = n.node LEFT JOIN r{i} ON r{i}.node = l.src GROUP BY n.node),
          r{i + 1} AS (SELECT node, 0.15 + 0.85 * (got + (SELECT (count(*) - sum(got)) / count(*) FROM g{i})) AS rank FROM g{i})"""
    return out + f" SELECT node, round(CAST(rank AS DOUBLE), 5) AS rank FROM r{rounds}"


@query("pagerank", _page_rank_sql(5))
def _(t, spark):
    return G.page_rank(_edges(t), rounds=5).select("node", F.round("rank", 5).alias("rank"))


@query("closeness_bfs")
def _(t, spark):
    return G.closeness_all(_edges(t))


@query("hyper_anf")
def _(t, spark):
    return G.hyper_anf(_edges(t))


@query("common_neighbours", f"""WITH e AS ({_EDGES}), p AS (SELECT DISTINCT l_suppkey + 1000000 AS a, l_suppkey + 1000001 AS b FROM lineitem)
  SELECT a, b, count(y.src) AS n FROM p LEFT JOIN e x ON x.dst = a LEFT JOIN e y ON y.dst = b AND y.src = x.src GROUP BY a, b""")
def _(t, spark):
    pairs = t("lineitem").select((F.col("l_suppkey") + 1000000).alias("a"), (F.col("l_suppkey") + 1000001).alias("b")).distinct()
    return G.common_neighbours(_edges(t), pairs, directed=True).select("a", "b", "n")  # part keys may be as large as suppliers' nodes


@query("node_labels", "SELECT c_custkey AS node, c_mktsegment AS label FROM customer")
def _(t, spark):
    labels = t("customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))
    return G.node_labels(t("customer").select(F.col("c_custkey").alias("node")), labels)


def _weighted(t) -> DataFrame:
    """All part-supplier edges, weighted by the lines that name both."""
    return t("lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query("modularity", """WITH e AS (SELECT l_partkey AS src, 1000000 + l_suppkey AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
  c AS (SELECT src % 3 AS a, dst % 3 AS b, w FROM e), d AS (SELECT c, sum(w) AS w FROM (SELECT a AS c, w FROM c UNION ALL SELECT b, w FROM c) GROUP BY c)
  SELECT round((SELECT sum(CASE WHEN a = b THEN w ELSE 0 END) / sum(w) FROM c) - (SELECT sum(w * w) FROM d) / (4 * (SELECT sum(w) * sum(w) FROM c)), 6) AS q""")
def _(t, spark):
    e = _weighted(t)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return G.modularity(e, nodes.withColumn("community", F.col("node") % 3)).select(F.round("q", 6).alias("q"))


@query("louvain")
def _(t, spark):
    return G.louvain(_weighted(t), rounds=3, folds=2)


def _vectors(t) -> DataFrame:
    v = V.to_sparse(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("label"), v.alias("features"))


def _all(t) -> DataFrame:
    return _vectors(t).drop("l_orderkey")


_ROUND = """SELECT CAST(l_linenumber AS DOUBLE) AS label, CAST((l_quantity <> 0)::INT + (l_extendedprice <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT AS INTEGER) AS nnz,
  round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS total FROM lineitem"""


def _profile(df: DataFrame) -> DataFrame:
    return df.select("label", F.size("features.values").alias("nnz"), F.round(V.total(F.col("features.values")), 4).alias("total"))


@query("libsvm_roundtrip", _ROUND)
def _(t, spark):
    path = fresh_path(spark, "libsvm")
    vectors.write_libsvm(_all(t), path)
    return _profile(vectors.read_libsvm(spark, path))


@query("libsvm_width", "SELECT CAST(4 AS BIGINT) AS width")
def _(t, spark):
    path = fresh_path(spark, "libsvm")
    vectors.write_libsvm(_all(t), path)
    return vectors.read_libsvm(spark, path).agg(F.max("features.size").alias("width"))


def _fields(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fields", F.transform("features.indices", lambda i: i % 2))


@query("ffm_roundtrip", _ROUND)
def _(t, spark):
    path = fresh_path(spark, "ffm")
    vectors.write_ffm(_fields(_all(t)), path)
    return _profile(vectors.read_ffm(spark, path))


@query("ffm_meta", "SELECT CAST(k AS BIGINT) AS key, CAST(k % 2 AS BIGINT) AS field FROM range(0, 4) AS r(k)")
def _(t, spark):
    path = fresh_path(spark, "ffm")
    vectors.write_ffm(_fields(_all(t)), path)
    return vectors.ffm_metadata(vectors.read_ffm(spark, path))


@query("dummy_roundtrip", """SELECT CAST(o_custkey % 2 AS DOUBLE) AS label, count(*) AS n, CAST(sum(o_orderkey % 5 + 10 + o_orderkey % 7) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def _(t, spark):
    path = fresh_path(spark, "dummy")
    keys = F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 7 + 10).cast("array<bigint>")
    v = F.struct(F.lit(17).cast("long").alias("size"), keys.alias("indices"), F.array(F.lit(1.0), F.lit(1.0)).alias("values"))
    vectors.write_dummy(t("orders").select((F.col("o_custkey") % 2).cast("double").alias("label"), v.alias("features")), path)
    back = vectors.read_dummy(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.aggregate("features.indices", F.lit(0).cast("long"), lambda a, i: a + i)).alias("keys"))


@query("edge_roundtrip", f"WITH e AS ({_EDGES}) SELECT src, dst, CAST(1.0 AS FLOAT) AS weight FROM e")
def _(t, spark):
    path = fresh_path(spark, "edges")
    graphs.write_edges(_edges(t), path)
    return graphs.read_edges(spark, path)


@query("embedding_sink", "SELECT vec_id AS node, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def _(t, spark):
    path = fresh_path(spark, "embedding")
    graphs.write_embedding(t("embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")), path)
    return graphs.read_embedding(spark, path).select("node", F.size("vector").alias("dim"))
