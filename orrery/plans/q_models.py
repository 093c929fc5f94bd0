"""Queries of the learners, hashing, matrices, random data and streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import boosting as B
from orrery.operators import embedding as E
from orrery.operators import embedding_table as ET
from orrery.operators import graph as G
from orrery.operators import linear as L
from orrery.operators import lsh
from orrery.operators import matrices as M
from orrery.operators import networks as N
from orrery.operators import params_table as P
from orrery.operators.formula import RFormula
from orrery.operators.text import dense_ids
from orrery.plans.registry import query
from orrery.plans.storage import cut, fresh_path, small_side
from orrery.streaming import ab_test

# ------------------------------------------------------------------ linear models on the table

_X = {0: "1.0", 1: "o_totalprice / 400000", 2: "(o_custkey % 7) / CAST(7 AS DOUBLE)", 3: "(o_orderkey % 5) / CAST(5 AS DOUBLE)"}
_ROW = "o_orderkey"
_DATA = "e AS (" + " UNION ALL ".join(f"SELECT {_ROW} AS r, {i} AS idx, ({x})::DOUBLE AS x FROM orders" for i, x in _X.items()) + f"), y AS (SELECT {_ROW} AS r, (o_orderstatus = 'F')::INT::DOUBLE AS y, o_totalprice / 100000 AS t FROM orders)"


def _entries(t) -> DataFrame:
    v = F.array(*[F.expr(x).cast("double") for x in _X.values()])
    return t("orders").select(F.expr(_ROW).alias("row_id"), F.posexplode(v).alias("idx", "value"))


def _labels(t, target: bool = False) -> DataFrame:
    y = F.col("o_totalprice") / 100000 if target else (F.col("o_orderstatus") == "F").cast("double")
    return t("orders").select(F.expr(_ROW).alias("row_id"), y.alias("label"))


_SLOPES = {
    "logloss": "1 / (1 + exp(-s)) - y",
    "hingeloss": "CASE WHEN (2 * y - 1) * s < 1 THEN -(2 * y - 1) ELSE 0 END",
    "l2loss": "s - t",
    "huberloss": "greatest(-1, least(1, s - t))",
}


def _steps_sql(loss: str, steps: int, rate: float) -> str:
    out = f"WITH {_DATA}, w0 AS (SELECT DISTINCT idx, 0.0::DOUBLE AS w FROM e)"
    for k in range(steps):
        out += f""", s{k} AS (SELECT r, sum(w * x) AS s FROM e JOIN w{k} USING (idx) GROUP BY r), g{k} AS (SELECT r, ({_SLOPES[loss]}) / (SELECT count(*) FROM y) AS g FROM s{k} JOIN y USING (r)),
          w{k + 1} AS (SELECT w{k}.idx, max(w) - {rate} * sum(x * g) AS w FROM w{k} JOIN e ON w{k}.idx = e.idx JOIN g{k} ON g{k}.r = e.r GROUP BY w{k}.idx)"""
    return out + f" SELECT CAST(idx AS INTEGER) AS idx, round(w, 6) + 0.0::DOUBLE AS value FROM w{steps}"


for _name, _loss, _rate in (("logreg_step", "logloss", 0.5), ("svm_step", "hingeloss", 0.1), ("linreg_step", "l2loss", 0.5), ("robustreg_step", "huberloss", 0.5)):

    @query(_name, _steps_sql(_loss, 3, _rate))
    def _(t, spark, loss=_loss, rate=_rate):
        table, _history = L.fit_linear(_entries(t), _labels(t, loss in ("l2loss", "huberloss")), loss, rate, 3)
        return table.select("idx", (F.round("value", 6) + 0.0).alias("value"))


_RULES = {
    "momentum": ("velocity", "0.9 * velocity + grad AS velocity", "velocity"),
    "adagrad": ("square", "square + grad * grad AS square", "grad / (sqrt(square) + 1e-8)"),
    "adam": ("first, second", "0.9 * first + (1 - 0.9) * grad AS first, 0.999 * second + (1 - 0.999) * grad * grad AS second", "first / (1 - pow(0.9, {k})) / (sqrt(second / (1 - pow(0.999, {k}))) + 1e-8)"),
}


def _optimizer_sql(rule: str, steps: int, rate: float) -> str:
    slots, update, step = _RULES[rule]
    out = f"WITH {_DATA}, w0 AS (SELECT DISTINCT idx, 0.0::DOUBLE AS value, {', '.join(f'0.0::DOUBLE AS {c}' for c in slots.split(', '))} FROM e)"
    for k in range(1, steps + 1):
        out += f""", s{k} AS (SELECT r, sum(value * x) AS s FROM e JOIN w{k - 1} USING (idx) GROUP BY r), d{k} AS (SELECT idx, sum(x * ({_SLOPES["logloss"]})) / (SELECT count(*) FROM y) AS grad FROM e JOIN s{k} USING (r) JOIN y USING (r) GROUP BY idx),
          u{k} AS (SELECT idx, value, grad, {update} FROM w{k - 1} JOIN d{k} USING (idx)), w{k} AS (SELECT idx, value - {rate} * {step.format(k=k)} AS value, {slots} FROM u{k})"""
    return out + f" SELECT CAST(idx AS INTEGER) AS idx, round(value, 6) + 0.0::DOUBLE AS value FROM w{steps}"


for _name, _rule in (("momentum_steps", "momentum"), ("adagrad_steps", "adagrad"), ("adam_steps", "adam")):

    @query(_name, _optimizer_sql(_rule, 3, 0.1))
    def _(t, spark, rule=_rule):
        table, _history = L.fit_linear(_entries(t), _labels(t), "logloss", 0.1, 3, rule)
        return table.select("idx", (F.round("value", 6) + 0.0).alias("value"))


@query("minibatch_logreg")
def _(t, spark):
    table, _history = L.fit_linear(_entries(t), _labels(t), "logloss", 0.5, 2, batches=3, decay="standard")
    return table.select("idx", F.round("value", 6).alias("value"))


@query("softmax_step", f"""WITH {_DATA}, c AS (SELECT {_ROW} AS r, o_custkey % 3 AS c FROM orders), k AS (SELECT * FROM range(0, 3) AS t(k))
  SELECT CAST(idx AS INTEGER) AS idx, CAST(k AS INTEGER) AS class, round(-0.5 * sum(x * (1 / 3.0 - (c = k)::INT)) / (SELECT count(*) FROM y), 6) + 0.0::DOUBLE AS value FROM e JOIN c USING (r), k GROUP BY ALL""")
def _(t, spark):
    labels = t("orders").select(F.expr(_ROW).alias("row_id"), (F.col("o_custkey") % 3).alias("label"))
    return L.fit_softmax(_entries(t), labels, 3, 0.5, 1).select("idx", "class", (F.round("value", 6) + 0.0).alias("value"))


@query("fm_score", f"""WITH {_DATA}, v AS (SELECT i AS idx, f, ((i + 1) * (f + 2) % 5) / 10.0 - 0.2 AS v FROM range(0, 4) AS a(i), range(0, 3) AS b(f)),
  l AS (SELECT r, sum((idx - 1) * 0.1 * x) AS l FROM e GROUP BY r), q AS (SELECT r, f, sum(v * x) AS s, sum(v * x * v * x) AS q FROM e JOIN v USING (idx) GROUP BY r, f),
  p AS (SELECT r, sum(s * s - q) / 2 AS p FROM q GROUP BY r) SELECT r AS row_id, round(l + p, 6) + 0.0::DOUBLE AS score FROM l JOIN p USING (r)""")
def _(t, spark):
    table = spark.range(4).select(F.col("id").alias("idx"), ((F.col("id") - 1) * 0.1).alias("value"))
    f = spark.range(4).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("f"))
    f = f.withColumn("value", ((F.col("idx") + 1) * (F.col("f") + 2) % 5) / 10.0 - 0.2)
    return L.fm_scores(_entries(t), table, f).select("row_id", (F.round("score", 6) + 0.0).alias("score"))


@query("fm_train")
def _(t, spark):
    _w, v, _history = L.fit_fm(_entries(t), _labels(t), 2, epochs=2)
    return v.select("idx", "f", F.round("value", 6).alias("value"))


@query("ftrl_batch", f"""WITH {_DATA}, s AS (SELECT idx, 0.3 * (idx + 1) AS z, 0.1 * idx AS n FROM range(0, 4) AS a(idx)), w AS (SELECT idx, z, n, CASE WHEN abs(z) <= 0.1 THEN 0 ELSE -(z - sign(z) * 0.1) / (0.1 + (1 + sqrt(n)) / 0.1) END AS w FROM s),
  p AS (SELECT r, 1 / (1 + exp(-sum(w * x))) - max(y) AS g FROM e JOIN w USING (idx) JOIN y USING (r) GROUP BY r)
  SELECT CAST(w.idx AS BIGINT) AS idx, round(max(z) + sum(g * x - (sqrt(n + g * x * g * x) - sqrt(n)) / 0.1 * w), 3) + 0.0::DOUBLE AS z, round(max(n) + sum(g * x * g * x), 4) AS n FROM e JOIN w USING (idx) JOIN p USING (r) GROUP BY w.idx""")
def _(t, spark):
    state = spark.range(4).select(F.col("id").alias("idx"), ((F.col("id") + 1) * 0.3).alias("z"), (F.col("id") * 0.1).alias("n"))
    out = L.ftrl_batch(state, _entries(t).withColumn("idx", F.col("idx").cast("long")), _labels(t))
    return out.select("idx", (F.round("z", 3) + 0.0).alias("z"), F.round("n", 4).alias("n"))


@query("ftrl_weights", "SELECT CAST(idx AS BIGINT) AS idx, round(-(z - sign(z) * 0.1) / (0.1 + (1 + sqrt(n)) / 0.1), 6) AS value FROM (SELECT p_partkey AS idx, (p_size - 25) / 10.0 AS z, p_retailprice / 100 AS n FROM part) WHERE abs(z) > 0.1")
def _(t, spark):
    state = t("part").select(F.col("p_partkey").alias("idx"), ((F.col("p_size") - 25) / 10.0).alias("z"), (F.col("p_retailprice") / 100).alias("n"))
    return L.ftrl_weights(state).select("idx", F.round("value", 6).alias("value"))


@query("ftrl_fm", f"""WITH {_DATA}, v AS (SELECT i AS idx, f, (i + 1) * 0.1::DOUBLE AS z, -((i + 1) * 0.1::DOUBLE) / (0.1 + 1 / 0.1) AS v FROM range(0, 4) AS a(i), range(0, 2) AS b(f)),
  s AS (SELECT r, f, sum(v * x) AS s, sum(v * x * v * x) AS q FROM e JOIN v USING (idx) GROUP BY r, f), p AS (SELECT r, 1 / (1 + exp(-sum(s * s - q) / 2)) - max(y) AS err FROM s JOIN y USING (r) GROUP BY r),
  g AS (SELECT idx, f, z, v, err * (x * s - v * x * x) AS g FROM e JOIN v USING (idx) JOIN s USING (r, f) JOIN p USING (r))
  SELECT CAST(idx AS BIGINT) AS idx, CAST(f AS INTEGER) AS f, round(max(z) + sum(g - abs(g) / 0.1 * v), 3) + 0.0::DOUBLE AS z, round(sum(g * g), 4) + 0.0::DOUBLE AS n FROM g GROUP BY idx, f""")
def _(t, spark):
    state = spark.range(4).select(F.col("id").alias("idx"), F.lit(0.0).alias("z"), F.lit(0.0).alias("n"))
    f = state.select("idx", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("f"), ((F.col("idx") + 1) * 0.1).alias("z"), "n")
    new = L.ftrl_fm_batch(state, f, _entries(t).withColumn("idx", F.col("idx").cast("long")), _labels(t))[1]
    return new.select("idx", "f", (F.round("z", 3) + 0.0).alias("z"), (F.round("n", 4) + 0.0).alias("n"))


@query("params_table", """SELECT round(sum(value), 2) AS total, round(max(value), 2) AS max, round(min(value), 2) AS min, count(*) FILTER (value <> 0) AS nnz, count(*) AS size, round(sqrt(sum(value * value)), 2) AS norm2
  FROM (SELECT c_acctbal * 2 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS value FROM customer)""")
def _(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))
    b = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("idx"), F.lit(1.0).alias("value"))
    r = P.reductions(P.zip_values(P.map_values(a, lambda x: x * 2), b, lambda x, y: x + y))
    return r.select(*[F.round(c, 2).alias(c) if c not in ("nnz", "size") else F.col(c) for c in r.columns])


@query("params_dot", "SELECT round(sum(c_acctbal * c_acctbal), 2) AS dot FROM customer WHERE c_custkey % 2 = 0")
def _(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))
    return P.dot(a, a.where("idx % 2 = 0")).select(F.round("dot", 2).alias("dot"))


def _wide(t) -> DataFrame:
    return t("orders").select(F.expr(_ROW).alias("row_id"), F.array(*[F.expr(x).cast("double") for x in list(_X.values())[1:]]).alias("features"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))


@query("logreg_scores", f"WITH s AS (SELECT {_ROW} AS row_id, 0.137::DOUBLE + 0.5 * (o_totalprice / 400000) - 1.0 * ((o_custkey % 7) / 7::DOUBLE) + 0.25 * ((o_orderkey % 5) / 5::DOUBLE) AS s FROM orders) SELECT row_id, round(1 / (1 + exp(-s)), 6) AS probability, (s > 0)::INT::DOUBLE AS prediction FROM s")
def _(t, spark):
    m = L.LinearModel(weights=[0.5, -1.0, 0.25], bias=0.137)
    return m.transform(_wide(t)).select("row_id", F.round("probability", 6).alias("probability"), "prediction")


@query("one_vs_rest")
def _(t, spark):
    df = _wide(t).withColumn("label", F.col("row_id") % 3)
    return L.OneVsRest(classes=3, epochs=2).fit(df).transform(df).groupBy("prediction").agg(F.count("*").alias("n"))


@query("document_quality")
def _(t, spark):
    """Hashed words of documents, a logistic model of their quality, and its scores."""
    from orrery.operators.text import HashingTF, RegexTokenizer

    docs = t("documents").join(t("labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    tf = HashingTF(input="w", output="tf", size=256, binary=True).transform(RegexTokenizer(input="text", output="w").transform(docs))
    entries = tf.select(F.col("doc_id").alias("row_id"), F.explode(F.arrays_zip(F.col("tf.indices").alias("i"), F.col("tf.values").alias("x"))).alias("e")).select("row_id", F.col("e.i").alias("idx"), F.col("e.x").alias("value"))
    labels = docs.select(F.col("doc_id").alias("row_id"), "label")
    table, _history = L.fit_linear(entries, labels, "logloss", 0.05, 3)
    scored = L.scores(entries, labels, table)
    return scored.select(F.col("row_id").alias("doc_id"), "label", F.round(L.sigmoid(F.col("score")), 6).alias("probability"))


# ------------------------------------------------------------------ boosted trees

_FIDS = {0: "o_totalprice", 1: "o_custkey % 7", 2: "o_orderkey % 5", 3: "o_custkey % 11"}


def _features(t) -> DataFrame:
    v = F.array(*[F.expr(c).cast("double") for c in _FIDS.values()])
    return t("orders").select(F.expr(_ROW).alias("row_id"), F.posexplode(v).alias("fid", "value"))


def _rows(t) -> DataFrame:
    return t("orders").select(F.expr(_ROW).alias("row_id"), F.lit(0).alias("node"), (0.5 - (F.col("o_orderstatus") == "F").cast("int")).alias("g"), F.lit(0.25).alias("h"))


@query("gbdt_candidate_splits", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS fid, count(DISTINCT {c}) <= 16 AS categorical, CAST(CASE WHEN count(DISTINCT {c}) <= 16 THEN count(DISTINCT {c}) ELSE 20 END AS INTEGER) AS n FROM orders" for i, c in _FIDS.items()))
def _(t, spark):
    return B.candidate_splits(_features(t)).select("fid", "categorical", F.size("splits").alias("n"))


def _bins(t) -> DataFrame:
    return B.binned(_features(t), B.candidate_splits(_features(t)))


@query("gbdt_bins")
def _(t, spark):
    return _bins(t).groupBy("fid", "bin").agg(F.count("*").alias("n"))


@query("gbdt_histogram")
def _(t, spark):
    return B.histogram(_bins(t), _rows(t))


@query("gbdt_root_split")
def _(t, spark):
    rows = _rows(t)
    totals = rows.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    best = B.best_splits(B.histogram(_bins(t), rows), totals, min_gain=-math.inf)
    return best.select("fid", "bin", F.round("gain", 4).alias("gain"))


_SETS = "f AS (" + " UNION ALL ".join(f"SELECT {_ROW} AS r, {i} AS fid, {c} AS bin FROM orders" for i, c in _FIDS.items() if i) + "), y AS (SELECT " + _ROW + " AS r, 0.5::DOUBLE - (o_orderstatus = 'F')::INT AS g, 0.25::DOUBLE AS h FROM orders)"


@query("gbdt_categorical_split", f"""WITH {_SETS}, t AS (SELECT sum(g) AS tg, sum(h) AS th FROM y), c AS (SELECT fid, bin, sum(g) AS g, sum(h) AS h FROM f JOIN y USING (r) GROUP BY fid, bin),
  l AS (SELECT fid, list_concat([{{'g': 0.0::DOUBLE, 'h': 0.0::DOUBLE, 'gl': coalesce(sum(g) FILTER (bin = 0), 0), 'hl': coalesce(sum(h) FILTER (bin = 0), 0), 'mask': 1::BIGINT}}],
    list({{'g': g, 'h': h, 'gl': 0.0::DOUBLE, 'hl': 0.0::DOUBLE, 'mask': (1::BIGINT << bin::INT)::BIGINT}} ORDER BY bin) FILTER (bin > 0)) AS bins FROM c GROUP BY fid),
  s AS (SELECT fid, tg, th, list_reduce(bins, lambda a, x: {{'g': x.g, 'h': x.h, 'gl': a.gl + CASE WHEN x.g * (2 * a.gl + x.g - tg) >= 0 THEN x.g ELSE 0 END,
    'hl': a.hl + CASE WHEN x.g * (2 * a.gl + x.g - tg) >= 0 THEN x.h ELSE 0 END, 'mask': a.mask + CASE WHEN x.g * (2 * a.gl + x.g - tg) >= 0 THEN x.mask ELSE 0 END}}) AS s FROM l, t)
  SELECT CAST(fid AS INTEGER) AS fid, CAST(s.mask AS BIGINT) AS mask, round(s.gl * s.gl / (s.hl + 1) + (tg - s.gl) * (tg - s.gl) / (th - s.hl + 1) - tg * tg / (th + 1) - 1, 4) AS gain FROM s WHERE th - s.hl > 1e-12""")
def _(t, spark):
    """The root's division of the categories of three features."""
    rows, hist = _rows(t), B.histogram(_bins(t), _rows(t)).where("fid > 0")
    total = rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
    sums = {0: (np.array([total.g]), np.array([total.h]))}
    found = B.scanned_splits(hist, ["g"], ["h"], sums, dict.fromkeys((1, 2, 3), 0), {}, B.Settings(min_gain=-math.inf))
    mask = F.aggregate("left", F.lit(0).cast("long"), lambda a, b: a + F.pow(F.lit(2.0), b).cast("long"))
    return found.select("fid", mask.alias("mask"), F.round("gain", 4).alias("gain"))


@query("gbdt_multiclass")
def _(t, spark):
    """Trees for the three order states, with a full Hessian; how often each state is called."""
    states = {"F": 0, "O": 1, "P": 2}
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col("o_orderstatus")), F.lit(2))
    labels = t("orders").select(F.expr(_ROW).alias("row_id"), code.alias("label"))
    m = B.boost(_features(t), labels, "multinomial", rounds=2, depth=3, classes=3, hessian="full")
    called = t("orders").select(m.predict(lambda f: F.expr(_FIDS[f])).alias("state"))
    return called.groupBy("state").agg(F.count("*").alias("n"))


@query("gbdt_predict", """SELECT o_orderkey AS row_id, round(0.1 * (CASE WHEN o_totalprice < 150000 THEN CASE WHEN o_custkey % 7 < 3 THEN -0.5 ELSE 0.25 END ELSE 1.0 END) + 0.1 * (CASE WHEN o_orderkey % 5 < 2 THEN 0.75 ELSE -0.75 END), 6)::DOUBLE AS score FROM orders""")
def _(t, spark):
    one = B.Tree({0: (0, 0, 150000.0, 1.0), 1: (1, 0, 3.0, 1.0)}, {3: -0.5, 4: 0.25, 2: 1.0})
    two = B.Tree({0: (2, 0, 2.0, 1.0)}, {1: 0.75, 2: -0.75})
    s = B.BoostedModel([one, two], 0.1).score(lambda f: F.expr(_FIDS[f]))
    return t("orders").select(F.expr(_ROW).alias("row_id"), F.round(s, 6).alias("score"))


@query("gbdt_train")
def _(t, spark):
    labels = t("orders").select(F.expr(_ROW).alias("row_id"), ((F.col("o_totalprice") > 150000) & (F.col("o_custkey") % 7 < 3)).cast("int").alias("label"))
    m = B.boost(_features(t), labels, rounds=2, depth=3)
    return spark.createDataFrame([(f, n, mean, total) for f, (n, mean, total) in m.importance().items()], "fid int, splits int, mean_gain double, total_gain double")


# ------------------------------------------------------------------ networks and embeddings


@query("networks")
def _(t, spark):
    """Loss before and after two epochs for every shipped family."""
    df = _wide(t).select("features", "label")
    out = []
    for name in ("logreg", "svm", "linreg", "robustreg", "fm", "mixedlr", "dnn", "daw", "deepfm", "nfm", "pnn", "afm", "dcn"):
        spec, loss = N.family(name)
        m = N.train_network(df, N.Network(spec, 3, 3), loss, epochs=2, rate=0.05)
        out.append((name, m.history[0], m.history[-1]))
    return spark.createDataFrame(out, "model string, first double, last double")


@query("line_embedding")
def _(t, spark):
    """Every distinct part-supplier edge over the dense ids of its nodes; node is the original id."""
    e = cut(t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct(), "edges")
    ids = cut(G.node_index(e), "ids")
    near = small_side(ids)
    dense = e.join(near.toDF("src", "a"), "src").join(near.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    vectors, _history = E.line_vectors(cut(dense, "edges"), ids.count(), dim=8, epochs=2, name="idx")
    return vectors.join(ids, "idx").select("node", F.size("vector").alias("dim"))


@query("word2vec")
def _(t, spark):
    """Orders as sentences of all their part keys; node is the part key."""
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    ids = cut(dense_ids(lines.select(F.col("l_partkey").alias("node")).distinct(), "node", "idx"), "ids")
    s = lines.join(small_side(ids), F.col("l_partkey") == F.col("node")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("idx").cast("long"))).alias("words"))
    vectors, _history = E.word2vec_vectors(cut(s.select("words"), "sentences"), ids.count(), dim=8, epochs=2, name="idx")
    return vectors.join(ids, "idx").select("node", F.size("vector").alias("dim"))


def _line_sql(epochs: int, dim: int, negatives: int, rate: float) -> str:
    def drawn(n: str, *terms: str) -> str:
        x = f"((1 + {' + '.join(f'({t}) * {p}::BIGINT' for t, p in zip(terms, ET.PRIMES, strict=False))}) % {ET.MODULUS})"
        for _ in range(2):
            x = f"((({x}) + 1) * {ET.FACTOR}::BIGINT % {ET.MODULUS})"
        return f"({x} % {n})"

    first = ", ".join(f"({drawn('1000003', 'idx', str(i), '1')} / 1000003::DOUBLE - 0.5) / {dim}" for i in range(dim))
    out = f"""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
      n AS (SELECT count(*) AS n FROM i), p AS (SELECT x.idx AS a, y.idx AS b FROM e JOIN i x ON x.node = src JOIN i y ON y.node = dst),
      a0 AS (SELECT idx, [{first}] AS x FROM i), b0 AS (SELECT idx, [{", ".join(["0.0::DOUBLE"] * dim)}] AS x FROM i)"""
    for k in range(epochs):
        means = lambda c: "[" + ", ".join(f"avg(e * {c}[{d + 1}])" for d in range(dim)) + "]"
        moved = "[" + ", ".join(f"x[{d + 1}] - {rate} * coalesce(g[{d + 1}], 0)" for d in range(dim)) + "]"
        out += f""", d{k} AS (SELECT a, b, j, n, {drawn("n", "a", "b", "j", str(k))} AS o FROM p, n, range(0, {negatives + 1}) AS r(j)),
          s{k} AS (SELECT a, CASE WHEN j = 0 THEN b WHEN o = a THEN (o + 1) % n ELSE o END AS c, (j = 0)::INT AS y FROM d{k}),
          t{k} AS (SELECT a, c, u.x AS u, v.x AS v, 1 / (1 + exp(-({" + ".join(f"u.x[{d + 1}] * v.x[{d + 1}]" for d in range(dim))}))) - y AS e FROM s{k} JOIN a{k} u ON u.idx = a JOIN b{k} v ON v.idx = c),
          a{k + 1} AS (SELECT idx, {moved} AS x FROM a{k} LEFT JOIN (SELECT a AS idx, {means("v")} AS g FROM t{k} GROUP BY a) USING (idx)),
          b{k + 1} AS (SELECT idx, {moved} AS x FROM b{k} LEFT JOIN (SELECT c AS idx, {means("u")} AS g FROM t{k} GROUP BY c) USING (idx))"""
    return out + f" SELECT node, {', '.join(f'round(x[{d + 1}], 6) + 0.0::DOUBLE AS x{d}' for d in range(dim))} FROM a{epochs} JOIN i USING (idx)"


@query("line_table", _line_sql(3, 3, 2, 0.5))
def _(t, spark):
    """Second-order LINE over all part-supplier edges, with its vectors in tables."""
    e = t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    ids = cut(G.node_index(e), "ids")
    dense = e.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    vectors, _history = ET.line(cut(dense, "edges"), ids.select("idx"), dim=3, order=2, negatives=2, epochs=3, rate=0.5)
    return vectors.join(ids, "idx").select("node", *[(F.round(F.get("vector", d), 6) + 0.0).alias(f"x{d}") for d in range(3)])


@query("word2vec_table")
def _(t, spark):
    """Orders as sentences of all their part keys, skip-gram with its vectors in tables."""
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    ids = cut(dense_ids(lines.select(F.col("l_partkey").alias("node")).distinct(), "node", "idx"), "ids")
    s = lines.join(ids, F.col("l_partkey") == F.col("node")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("idx")).alias("words"))
    vectors, _history = ET.word2vec(cut(s, "sentences"), ids.select("idx"), window=2, dim=4, negatives=2, epochs=2)
    return vectors.join(ids, "idx").select("node", *[F.round(F.get("vector", d), 6).alias(f"x{d}") for d in range(4)])


def _kmeans_sql(rounds: int) -> str:
    distance = "list_sum(list_transform(list_zip(e.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    out = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c0 AS (SELECT vec_id AS cluster, v FROM e WHERE vec_id < 4)"
    for k in range(rounds):
        out += f""", a{k} AS (SELECT vec_id, arg_min(c.cluster, {{'d': {distance}, 'c': c.cluster}}) AS cluster FROM e, c{k} c GROUP BY vec_id),
          m{k} AS (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} JOIN e USING (vec_id)) GROUP BY cluster, i),
          c{k + 1} AS (SELECT cluster, list(x ORDER BY i) AS v FROM m{k} GROUP BY cluster)"""
    return out + f", a{rounds} AS (SELECT vec_id, arg_min(c.cluster, {{'d': {distance}, 'c': c.cluster}}) AS cluster FROM e, c{rounds} c GROUP BY vec_id) SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM a{rounds} GROUP BY cluster"


@query("kmeans", _kmeans_sql(3))
def _(t, spark):
    """Three rounds from the first four vectors."""
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    start = [list(r.v) for r in df.where("vec_id < 4").orderBy("vec_id").collect()]
    centres, _history = M.kmeans(df, "v", 4, 3, start=start)
    return M.assigned(df, "v", centres).groupBy("cluster").agg(F.count("*").alias("n"))


@query("rformula", """WITH m AS (SELECT l_returnflag AS f, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS i FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS idx, round(CASE k WHEN 0 THEN (i = 0)::INT WHEN 1 THEN (i = 1)::INT WHEN 2 THEN l_quantity ELSE l_quantity * l_discount END, 6) + 0.0::DOUBLE AS value
  FROM lineitem JOIN m ON l_returnflag = f, range(0, 4) AS r(k)""")
def _(t, spark):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    m = RFormula(formula="l_tax ~ l_returnflag + l_quantity + l_quantity:l_discount").fit(df)
    return m.transform(df).select("l_orderkey", "l_linenumber", F.posexplode("features").alias("idx", "x")).select("l_orderkey", "l_linenumber", "idx", (F.round("x", 6) + 0.0).alias("value"))


# ------------------------------------------------------------------ locality-sensitive hashing

_COEF = [(1, 2), (3, 5), (7, 11)]


@query("minhash", "WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, " + ", ".join(f"list_min(list_transform(p, lambda i: ((i + 1) * {a} + {b}) % 2038074743)) AS h{k}" for k, (a, b) in enumerate(_COEF)) + " FROM s")
def _(t, spark):
    s = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p")).withColumn("h", lsh.minhash(F.col("p"), _COEF))
    return s.select("l_orderkey", *[F.get("h", k).alias(f"h{k}") for k in range(3)])


@query("minhash_join", f"""WITH s AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey)) AS p FROM lineitem GROUP BY 1), h AS (SELECT k, unnest([{", ".join(f"'{i}:' || list_min(list_transform(p, lambda i: ((i + 1) * {a} + {b}) % 2038074743))" for i, (a, b) in enumerate(_COEF))}]) AS h FROM s),
  j AS (SELECT DISTINCT a.k AS ia, b.k AS ib FROM h a JOIN h b USING (h) WHERE a.k < b.k), d AS (SELECT ia, ib, len(list_intersect(a.p, b.p)) AS m, len(a.p) + len(b.p) AS total FROM j JOIN s a ON a.k = ia JOIN s b ON b.k = ib)
  SELECT ia, ib, round(1 - m / (total - m), 6) AS distance FROM d WHERE 1 - m / (total - m) < 0.5""")
def _(t, spark):
    """Every order with its own part keys."""
    s = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("p")).withColumn("h", lsh.minhash(F.col("p"), _COEF))
    out = lsh.similarity_join(s, s, "k", "k", "h", "p", lsh.jaccard_distance, 0.5)
    return out.where("ia < ib").select("ia", "ib", F.round("distance", 6).alias("distance"))


@query("brp_lsh", "SELECT l_orderkey, l_linenumber, CAST(floor((l_quantity * 0.6 + l_tax * 0.8) / 0.5) AS BIGINT) AS h0, CAST(floor((l_quantity * 0.8 - l_tax * 0.6) / 0.5) AS BIGINT) AS h1 FROM lineitem")
def _(t, spark):
    df = t("lineitem").withColumn("h", lsh.projection(F.array("l_quantity", "l_tax"), [[0.6, 0.8], [0.8, -0.6]], 0.5))
    return df.select("l_orderkey", "l_linenumber", F.get("h", 0).alias("h0"), F.get("h", 1).alias("h1"))


@query("knn", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS query, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS r FROM d) SELECT query, id, round(d, 5) AS distance, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5""")
def _(t, spark):
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = lsh.nearest_exact(df, df.where("vec_id % 100 = 0"), "vec_id", "v", 5)
    return out.select("query", "id", F.round("distance", 5).alias("distance"), "rank")


_DIRECTIONS = lsh.unit_gaussians(16, 64, 1)
_HASHED = "SELECT vec_id, v, [" + ", ".join(f"CAST(floor(list_sum(list_transform(list_zip(v, {[float(x) for x in r]}), lambda x: x[1] * x[2])) / 0.1) AS BIGINT)" for r in _DIRECTIONS) + "] AS h FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_FAR = "sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


def _projected(t) -> DataFrame:
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return df.withColumn("h", lsh.projection(F.col("v"), _DIRECTIONS, 0.1))


@query("ann", f"""WITH e AS ({_HASHED}), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
  d AS (SELECT q.vec_id AS query, e.vec_id AS id, {_FAR} AS d FROM q JOIN e ON q.vec_id <> e.vec_id WHERE len(list_filter(range(1, 17), lambda i: q.h[i] = e.h[i])) > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS r FROM d) SELECT query, id, round(d, 5) AS distance, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 10""")
def _(t, spark):
    """Every row whose id is divisible by 100 against all rows."""
    df = _projected(t)
    out = lsh.nearest_each(df, df.where("vec_id % 100 = 0"), "vec_id", "h", "v", lsh.euclidean, 10)
    return out.select("query", "id", F.round("distance", 5).alias("distance"), "rank")


@query("ann_multi_probe", f"""WITH e AS ({_HASHED}), q AS (SELECT * FROM e WHERE vec_id = 0),
  p AS (SELECT e.vec_id, list_min(list_transform(range(1, 17), lambda i: abs(q.h[i] - e.h[i]))) AS p, {_FAR} AS d FROM e, q),
  m AS (SELECT max(p) AS most FROM (SELECT p FROM p ORDER BY p LIMIT 10)) SELECT vec_id, round(d, 5) AS distance FROM p, m WHERE p <= most ORDER BY d, vec_id LIMIT 10""")
def _(t, spark):
    df = _projected(t)
    key = df.where("vec_id = 0").first()
    out = lsh.nearest(df, list(key.h), F.array(*[F.lit(x) for x in key.v]), "h", "v", lsh.euclidean, 10, "vec_id", multi_probe=True)
    return out.select("vec_id", F.round("distance", 5).alias("distance"))


# ------------------------------------------------------------------ matrices and random data

_A = "SELECT l_orderkey % 30 AS i, l_partkey % 20 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def _a(t) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_orderkey") % 30).alias("i"), (F.col("l_partkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("value"))


@query("coordinate_multiply", f"WITH a AS ({_A}) SELECT x.i, y.i AS j, CAST(sum(x.v * y.v) AS DOUBLE) AS value FROM a x JOIN a y ON x.j = y.j GROUP BY ALL")
def _(t, spark):
    return M.multiply(_a(t), M.transpose(_a(t)))


@query("coordinate_add", f"WITH a AS ({_A}) SELECT i, j, sum(v) AS value FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, -v FROM a) GROUP BY ALL")
def _(t, spark):
    return M.subtract(_a(t), M.transpose(_a(t)))


@query("block_multiply", f"WITH a AS ({_A}) SELECT x.i, y.i AS j, CAST(sum(x.v * y.v) AS DOUBLE) AS value FROM a x JOIN a y ON x.j = y.j GROUP BY ALL")
def _(t, spark):
    a, b = M.to_blocks(_a(t), 8), M.to_blocks(M.transpose(_a(t)), 8)
    return M.from_blocks(M.multiply_blocks(a, b, 8), 8)


@query("gramian", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(sum({a} * {b}), 2) AS value FROM lineitem" for i, a in enumerate(("l_quantity", "l_discount", "l_tax")) for j, b in enumerate(("l_quantity", "l_discount", "l_tax")) if i <= j))
def _(t, spark):
    df = t("lineitem").select(V.dense("l_quantity", "l_discount", "l_tax").alias("v"))
    return M.gramian(df, "v", 3).select("i", "j", F.round("value", 2).alias("value"))


@query("cosine_similarities", f"WITH a AS ({_A}), n AS (SELECT j, sqrt(sum(v * v)) AS n FROM a GROUP BY j) SELECT x.j AS i, y.j, round(sum(x.v * y.v / (nx.n * ny.n)), 6) AS value FROM a x JOIN a y ON x.i = y.i AND x.j < y.j JOIN n nx ON x.j = nx.j JOIN n ny ON y.j = ny.j GROUP BY x.j, y.j")
def _(t, spark):
    return M.cosine_similarities(_a(t)).select("i", "j", F.round("value", 6).alias("value"))


@query("svd")
def _(t, spark):
    df = t("lineitem").select(V.dense("l_quantity", "l_discount", "l_tax").alias("v"))
    return spark.createDataFrame([(i, round(float(s), 4)) for i, s in enumerate(M.svd(df, "v", 3, 3)[0])], "i int, s double")


@query("pca")
def _(t, spark):
    df = t("lineitem").select(V.dense("l_quantity", "l_discount", "l_tax").alias("v"))
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(M.pca(df, "v", 3, 2)[1])], "i int, share double")


@query("qr")
def _(t, spark):
    df = t("lineitem").select(V.dense("l_quantity", "l_discount", "l_tax").alias("v"))
    r = M.qr(df, "v", 3)
    return spark.createDataFrame([(i, j, round(float(r[i, j]), 4)) for i in range(3) for j in range(i, 3)], "i int, j int, value double")


for _kind in ("uniform", "normal", "exponential", "lognormal", "weibull", "poisson", "gamma"):

    @query(f"random_{_kind}")
    def _(t, spark, kind=_kind):
        return M.random_columns(spark, 1000, kind, 7)


@query("linear_data")
def _(t, spark):
    return M.linear_data(spark, 500, [1.0, -2.0], 0.5, 0.1, 3).select("id", "label")


# ------------------------------------------------------------------ streams

_AB = "SELECT (user_id % 2 = 0) AS experiment, value AS x, strftime(ts, '%Y-%m-%d') AS day FROM events"


def _stats(t) -> DataFrame:
    return ab_test.group_statistics(t("events"), F.col("user_id") % 2 == 0, F.col("value"), F.col("ts"), "1 day")


@query("ab_statistics", f"SELECT day AS window_start, experiment, count(x) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 4) AS variance FROM ({_AB}) GROUP BY day, experiment")
def _(t, spark):
    return _stats(t).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).select("window_start", "experiment", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("ab_test", f"""WITH s AS (SELECT day, experiment, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM ({_AB}) GROUP BY ALL)
  SELECT a.day AS window_start, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS statistic, round((a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / (a.v / a.n * (a.v / a.n) / (a.n - 1) + b.v / b.n * (b.v / b.n) / (b.n - 1)), 3) AS df
  FROM s a JOIN s b ON a.day = b.day AND a.experiment AND NOT b.experiment""")
def _(t, spark):
    return ab_test.t_statistic(ab_test.paired(_stats(t))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).select("window_start", F.round("statistic", 5).alias("statistic"), F.round("df", 3).alias("df"))


@query("ab_stream", f"SELECT day AS window_start, experiment, count(x) AS n, round(avg(x), 6) AS mean FROM ({_AB}) GROUP BY day, experiment")
def _(t, spark):
    """The same windows from a stream over the events, run to its end."""
    source = t("events")
    folder, name = source.inputFiles()[0].rsplit("/", 1)
    if len(source.inputFiles()) > 1:
        name = "*.parquet"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", name).parquet(folder)
    stats = ab_test.group_statistics(stream, F.col("user_id") % 2 == 0, F.col("value"), F.col("ts"), "1 day")
    out = fresh_path(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    q = stats.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).select("window_start", "experiment", "n", F.round("mean", 6).alias("mean"))
