"""Queries of the scalar and vector transformers. Vectors are returned in long form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import scalar as S
from orrery.operators import vector as O
from orrery.plans.registry import query

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEYS = ("l_orderkey", "l_linenumber")


def _long(df: DataFrame, vector: str, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("idx", "x")).select(*keys, "idx", (F.round("x", digits) + 0.0).alias("value"))


def _line(t) -> DataFrame:
    return t("lineitem").select(*KEYS, *LINE, "l_returnflag", V.dense(*LINE).alias("v"))


def _unrolled(expressions: list[str], source: str = "lineitem", keys=KEYS, digits: int = 6, ctes: str = "") -> str:
    """SQL of one row for each component."""
    k = ", ".join(keys)
    parts = [f"SELECT {k}, CAST({i} AS INTEGER) AS idx, round(CAST({e} AS DOUBLE), {digits}) + 0.0::DOUBLE AS value FROM {source}" for i, e in enumerate(expressions)]
    return ctes + " UNION ALL ".join(parts)


@query("binarizer", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS binarized FROM lineitem")
def _(t, spark):
    return S.Binarizer(input="l_discount", threshold=0.05).transform(t("lineitem")).select(*KEYS, "binarized")


@query("binarizer_vector", _unrolled([f"CASE WHEN {c} > 10 THEN 1 ELSE 0 END" for c in LINE]))
def _(t, spark):
    return _long(S.Binarizer(input="v", output="o", threshold=10.0).transform(_line(t)), "o", *KEYS)


@query("bucketizer", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0.0::DOUBLE WHEN l_quantity < 25 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS q,
  CASE WHEN l_discount < 0.03 THEN 0.0::DOUBLE WHEN l_discount < 0.07 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS d FROM lineitem""")
def _(t, spark):
    b = S.Bucketizer(inputs=["l_quantity", "l_discount"], outputs=["q", "d"], splits=[[-math.inf, 10.0, 25.0, math.inf], [-math.inf, 0.03, 0.07, math.inf]])
    return b.transform(t("lineitem")).select(*KEYS, "q", "d")


@query("quantile_discretizer", """WITH q AS (SELECT quantile_disc(l_extendedprice, [0.25, 0.5, 0.75]) AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST((l_extendedprice >= s[1])::INT + (l_extendedprice >= s[2])::INT + (l_extendedprice >= s[3])::INT AS DOUBLE) AS bucket FROM lineitem, q""")
def _(t, spark):
    d = S.QuantileDiscretizer(inputs=["l_extendedprice"], outputs=["bucket"], num_buckets=4, relative_error=0.0)
    return d.fit(t("lineitem")).transform(t("lineitem")).select(*KEYS, "bucket")


_HOLES = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"


def _holes(t) -> DataFrame:
    return t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query("imputer_mean", f"WITH h AS ({_HOLES}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM h)), 6) AS imputed FROM h")
def _(t, spark):
    h = _holes(t)
    return S.Imputer(inputs=["value"], outputs=["imputed"]).fit(h).transform(h).select("event_id", F.round("imputed", 6).alias("imputed"))


@query("imputer_median", f"WITH h AS ({_HOLES}) SELECT event_id, round(coalesce(value, (SELECT quantile_disc(value, 0.5) FROM h)), 6) AS imputed FROM h")
def _(t, spark):
    h = _holes(t)
    m = S.Imputer(inputs=["value"], outputs=["imputed"], strategy="median", relative_error=1e-9).fit(h)
    return m.transform(h).select("event_id", F.round("imputed", 6).alias("imputed"))


_INDEX = "SELECT {c} AS label, row_number() OVER (ORDER BY {o}) - 1 AS i FROM {t} GROUP BY {c}"


@query("string_indexer", f"WITH m AS ({_INDEX.format(c='o_orderpriority', o='count(*) DESC, o_orderpriority', t='orders')}) SELECT o_orderkey, CAST(i AS DOUBLE) AS idx FROM orders JOIN m ON o_orderpriority = label")
def _(t, spark):
    m = S.StringIndexer(input="o_orderpriority", output="idx").fit(t("orders"))
    return m.transform(t("orders")).select("o_orderkey", "idx")


@query("string_indexer_alphabet", f"WITH m AS ({_INDEX.format(c='c_mktsegment', o='c_mktsegment DESC', t='customer')}) SELECT c_custkey, CAST(i AS DOUBLE) AS idx FROM customer JOIN m ON c_mktsegment = label")
def _(t, spark):
    m = S.StringIndexer(input="c_mktsegment", output="idx", order="alphabetDesc").fit(t("customer"))
    return m.transform(t("customer")).select("c_custkey", "idx")


@query("index_to_string", "SELECT o_orderkey, o_orderpriority AS label FROM orders")
def _(t, spark):
    o = S.StringIndexer(input="o_orderpriority", output="idx").fit(t("orders")).transform(t("orders"))
    return S.IndexToString(input="idx", output="label").transform(o).select("o_orderkey", "label")


@query("one_hot", f"""WITH m AS ({_INDEX.format(c='l_returnflag', o='count(*) DESC, l_returnflag', t='lineitem')}), n AS (SELECT count(*) AS n FROM m)
  SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS idx, CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM lineitem JOIN m ON l_returnflag = label, n, unnest(range(0, n.n - 1)) AS u(k)""")
def _(t, spark):
    i = S.StringIndexer(input="l_returnflag", output="i").fit(t("lineitem")).transform(t("lineitem"))
    return _long(S.OneHotEncoder(inputs=["i"], outputs=["o"]).fit(i).transform(i), "o", *KEYS)


@query("multi_hot", """SELECT c_custkey, CAST(k AS INTEGER) AS idx, CASE WHEN k = c_nationkey % 5 OR k = c_custkey % 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM customer, unnest(range(0, 5)) AS u(k)""")
def _(t, spark):
    c = t("customer").withColumn("s", F.array(F.col("c_nationkey") % 5, F.col("c_custkey") % 5))
    return _long(S.ArrayMultiHot(input="s", output="o", size=5).transform(c), "o", "c_custkey")


@query("vector_assembler", _unrolled([*LINE, "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END", "l_tax"]))
def _(t, spark):
    df = _line(t).withColumns({"big": F.col("l_quantity") > 25, "w": F.array("l_tax")})
    return _long(O.VectorAssembler(inputs=["v", "big", "w"], output="o").transform(df), "o", *KEYS)


@query("vector_slicer", _unrolled(["l_tax", "l_quantity"]))
def _(t, spark):
    return _long(O.VectorSlicer(input="v", output="o", indices=[3, 0]).transform(_line(t)), "o", *KEYS)


@query("vector_size_hint", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size FROM embeddings WHERE len(embedding) = 64")
def _(t, spark):
    return O.VectorSizeHint(input="embedding", size=64, handle_invalid="skip").transform(t("embeddings")).select("vec_id", F.size("embedding").alias("size"))


@query("standard_scaler", _unrolled([f"CASE WHEN sd{i} = 0 THEN 0 ELSE ({c} - m{i}) / sd{i} END" for i, c in enumerate(LINE)], "lineitem, s", ctes="WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS sd{i}" for i, c in enumerate(LINE)) + " FROM lineitem) "))
def _(t, spark):
    df = _line(t)
    return _long(O.StandardScaler(input="v", output="o", with_mean=True).fit(df).transform(df), "o", *KEYS)


@query("minmax_scaler", _unrolled([f"CASE WHEN b{i} = a{i} THEN 0 ELSE ({c} - a{i}) / (b{i} - a{i}) * 10 - 5 END" for i, c in enumerate(LINE)], "lineitem, s", ctes="WITH s AS (SELECT " + ", ".join(f"min({c}) AS a{i}, max({c}) AS b{i}" for i, c in enumerate(LINE)) + " FROM lineitem) "))
def _(t, spark):
    df = _line(t)
    return _long(O.MinMaxScaler(input="v", output="o", low=-5.0, high=5.0).fit(df).transform(df), "o", *KEYS)


@query("maxabs_scaler", _unrolled([f"{c} / CASE WHEN a{i} = 0 THEN 1 ELSE a{i} END" for i, c in enumerate(LINE)], "lineitem, s", ctes="WITH s AS (SELECT " + ", ".join(f"max(abs({c})) AS a{i}" for i, c in enumerate(LINE)) + " FROM lineitem) "))
def _(t, spark):
    df = _line(t)
    return _long(O.MaxAbsScaler(input="v", output="o").fit(df).transform(df), "o", *KEYS)


_NORMS = {
    "normalizer_p1": (1.0, "(abs(l_quantity) + abs(l_extendedprice) + abs(l_discount) + abs(l_tax))"),
    "normalizer_p2": (2.0, "sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax)"),
    "normalizer_inf": (math.inf, "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount), abs(l_tax))"),
}
for _name, (_p, _n) in _NORMS.items():

    @query(_name, _unrolled([f"{c} / {_n}" for c in LINE]))
    def _(t, spark, p=_p):
        return _long(O.Normalizer(input="v", output="o", p=p).transform(_line(t)), "o", *KEYS)


@query("elementwise_product", _unrolled(["l_quantity * 2.0", "l_extendedprice * 0.5", "l_discount * -1.0", "l_tax * 0.0"]))
def _(t, spark):
    return _long(O.ElementwiseProduct(input="v", output="o", scaling=[2.0, 0.5, -1.0, 0.0]).transform(_line(t)), "o", *KEYS)


@query("interaction", _unrolled([f"CASE WHEN {f} THEN {c} * l_quantity ELSE 0 END" for f in ("l_linenumber % 3 = 0", "l_linenumber % 3 = 1", "l_linenumber % 3 = 2") for c in ("l_discount", "l_tax")]))
def _(t, spark):
    df = t("lineitem").select(*KEYS, "l_quantity", (F.col("l_linenumber") % 3).alias("c"), F.array("l_discount", "l_tax").alias("w"))
    return _long(O.Interaction(inputs=["c", "w", "l_quantity"], output="o", levels={"c": 3}).transform(df), "o", *KEYS)


@query("polynomial_expansion", _unrolled(["l_quantity", "l_quantity * l_quantity", "l_discount", "l_quantity * l_discount", "l_discount * l_discount", "l_tax", "l_quantity * l_tax", "l_discount * l_tax", "l_tax * l_tax"]))
def _(t, spark):
    df = t("lineitem").select(*KEYS, F.array("l_quantity", "l_discount", "l_tax").alias("v"))
    return _long(O.PolynomialExpansion(input="v", output="o", degree=2, size=3).transform(df), "o", *KEYS)


@query("vector_indexer", """WITH m AS (SELECT v, row_number() OVER (ORDER BY v <> 0, v) - 1 AS i FROM (SELECT DISTINCT l_discount AS v FROM lineitem))
  SELECT l_orderkey, l_linenumber, CAST(0 AS INTEGER) AS idx, round(l_extendedprice, 6) AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(1 AS INTEGER), CAST(i AS DOUBLE) FROM lineitem JOIN m ON l_discount = v""")
def _(t, spark):
    df = t("lineitem").select(*KEYS, F.array("l_extendedprice", "l_discount").alias("v"))
    return _long(O.VectorIndexer(input="v", output="o", max_categories=20).fit(df).transform(df), "o", *KEYS)


def _dct(inverse: bool) -> list[str]:
    n = len(LINE)
    b = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]
    b = [list(x) for x in zip(*b, strict=True)] if inverse else b
    return [" + ".join(f"{c} * ({w!r}::DOUBLE)" for c, w in zip(LINE, row, strict=True)) for row in b]


for _name, _inverse in (("dct", False), ("dct_inverse", True)):

    @query(_name, _unrolled(_dct(_inverse), digits=4))
    def _(t, spark, inverse=_inverse):
        return _long(O.DCT(input="v", output="o", size=4, inverse=inverse).transform(_line(t)), "o", *KEYS, digits=4)


@query("sql_transformer", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def _(t, spark):
    s = S.SqlTransformer(statement="SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM __THIS__ GROUP BY o_orderstatus")
    return s.transform(t("orders"))


@query("column_pruner", "SELECT r_regionkey FROM region")
def _(t, spark):
    return S.ColumnPruner(drop=["r_name"]).transform(t("region"))


@query("feature_hasher", """SELECT o_orderkey, 1.0::DOUBLE * 2 + o_totalprice AS total FROM orders""")
def _(t, spark):
    # hashes have no SQL form; values add up to what was hashed, whatever collides
    h = O.FeatureHasher(inputs=["o_orderstatus", "o_orderpriority", "o_totalprice"], output="f").transform(t("orders"))
    return h.select("o_orderkey", F.aggregate(F.filter("f.values", lambda x: x != 1.0), F.lit(2.0) - 0 * F.size("f.indices"), lambda a, x: a + x).alias("total"))


@query("feature_hasher_vectors")
def _(t, spark):
    h = O.FeatureHasher(inputs=["o_orderstatus", "o_orderpriority", "o_totalprice"], output="f").transform(t("orders"))
    return h.select("o_orderkey", F.explode(F.arrays_zip(F.col("f.indices").alias("i"), F.col("f.values").alias("x"))).alias("e")).select("o_orderkey", "e.i", "e.x")


@query("sparse_codec", _unrolled(["l_discount", "l_tax"], digits=10))
def _(t, spark):
    df = t("lineitem").select(*KEYS, V.parse(V.show(V.to_sparse(F.array("l_discount", "l_tax")))).alias("s"))
    return _long(df.withColumn("o", V.to_dense(F.col("s"))), "o", *KEYS, digits=10)


@query("hash_folds", """SELECT l_orderkey % 5 AS fold, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t, spark):
    from orrery.operators.tuning import folds_by

    return folds_by(t("lineitem"), F.col("l_orderkey"), 5).groupBy("fold").agg(F.count("*").alias("n"))


@query("weighted_sample")
def _(t, spark):
    from orrery.operators.tuning import weighted_sample

    return weighted_sample(t("lineitem").select(*KEYS, "l_tax"), F.col("l_tax"), 5.0, 7, KEYS)
