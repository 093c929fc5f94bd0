"""Queries of summaries, correlation, tests, order statistics and evaluators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import evaluation as E
from orrery.operators import statistics as S
from orrery.plans.registry import query

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_R = ", 6)"


def _rounded(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.col(c) if c in exact else (F.round(c, digits) + 0.0).alias(c) for c in df.columns])


def _cells(digits=6) -> str:
    """Long entries of the vectors, zeros left out."""
    return " UNION ALL ".join(f"SELECT {i} AS idx, {c} AS x, l_linenumber AS w FROM lineitem WHERE {c} <> 0" for i, c in enumerate(COLUMNS))


def _entries(t) -> DataFrame:
    df = t("lineitem").select("l_linenumber", F.posexplode(V.dense(*COLUMNS)).alias("idx", "value"))
    return df.where("value <> 0").select(F.col("l_linenumber").alias("weight"), "idx", "value")


@query("summarizer", f"""WITH e AS ({_cells()}), n AS (SELECT count(*) AS n FROM lineitem), s AS (SELECT idx, count(*) AS c, sum(x) AS s, sum(x * x) AS ss, max(x) AS mx, min(x) AS mn, sum(abs(x)) AS l1 FROM e GROUP BY idx)
  SELECT CAST(idx AS INTEGER) AS idx, round(s / n, 4) AS mean, round((ss - s * s / n) / (n - 1), 3) AS variance, n AS count, c AS nnz,
    CASE WHEN c < n THEN greatest(mx, 0) ELSE mx END AS max, CASE WHEN c < n THEN least(mn, 0) ELSE mn END AS min, round(l1, 2) AS norm_l1, round(sqrt(ss), 3) AS norm_l2 FROM s, n""")
def _(t, spark):
    s = S.summarize(_entries(t), t("lineitem").count())
    return s.withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 3), "norm_l1": F.round("norm_l1", 2), "norm_l2": F.round("norm_l2", 3)})


@query("summarizer_weighted", f"""WITH e AS ({_cells()}) SELECT CAST(idx AS INTEGER) AS idx, round(sum(w * x) / sum(w), 4) AS mean,
  round((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / (sum(w) - sum(w * w)::DOUBLE / sum(w)), 3) AS variance, count(*) AS count FROM e GROUP BY idx""")
def _(t, spark):
    s = S.summarize(_entries(t), weighted=True)
    return s.select("idx", F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance"), "count")


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i:]]


@query("pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM {'(SELECT 1)' if a == b else 'lineitem'}" for a, b in _PAIRS))
def _(t, spark):
    return _rounded(S.pearson(t("lineitem"), COLUMNS), "a", "b")


@query("spearman", """WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT round(corr(a, b), 6) AS corr FROM r""")
def _(t, spark):
    return _rounded(S.spearman(t("orders"), "o_orderkey", "o_totalprice", "o_custkey"))


@query("average_ranks", "SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS DOUBLE) AS rank FROM orders")
def _(t, spark):
    return S.average_ranks(t("orders"), "o_orderkey", "o_custkey").select("o_orderkey", F.col("rank").cast("double").alias("rank"))


@query("chi_square", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb, sum(o) OVER () AS n FROM c)
  SELECT round(sum(o::DOUBLE * o * n / (ra::DOUBLE * rb)) - max(n), 4) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM m""")
def _(t, spark):
    s = S.chi_square_independence(S.contingency(t("lineitem"), "l_returnflag", "l_linestatus"))
    return s.select(F.round("statistic", 4).alias("statistic"), "df")


@query("contingency", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS observed FROM orders GROUP BY 1, 2")
def _(t, spark):
    return S.contingency(t("orders"), "o_orderstatus", "o_orderpriority")


_FEATURES = ("l_discount", "l_tax", "l_linenumber::DOUBLE")


@query("chi_square_by_feature", "WITH f AS (" + " UNION ALL ".join(f"SELECT {i} AS idx, {c} AS a, l_returnflag AS b FROM lineitem" for i, c in enumerate(_FEATURES)) + """), c AS (SELECT idx, a, b, count(*) AS o FROM f GROUP BY ALL),
  m AS (SELECT *, sum(o) OVER (PARTITION BY idx, a) AS ra, sum(o) OVER (PARTITION BY idx, b) AS rb, sum(o) OVER (PARTITION BY idx) AS n FROM c)
  SELECT CAST(idx AS INTEGER) AS idx, round(sum(o::DOUBLE * o * n / (ra::DOUBLE * rb)) - max(n), 4) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INTEGER) AS df FROM m GROUP BY idx""")
def _(t, spark):
    df = t("lineitem").select(V.dense("l_discount", "l_tax", "l_linenumber").alias("v"), "l_returnflag")
    return S.chi_square_by_feature(df, "v", "l_returnflag").select("idx", F.round("statistic", 4).alias("statistic"), "df")


@query("chi_square_fit", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), e AS (SELECT n, sum(n) OVER () / count(*) OVER () AS e FROM c) SELECT round(sum((n - e) * (n - e) / e), 4) AS statistic, count(*) - 1 AS df FROM e")
def _(t, spark):
    return S.chi_square_fit(t("events"), "event_type").select(F.round("statistic", 4).alias("statistic"), "df")


@query("chi_sq_selector", None)
def _(t, spark):
    from orrery.operators.vector import ChiSqSelector

    df = t("lineitem").select("l_orderkey", "l_linenumber", V.dense("l_discount", "l_tax", "l_linenumber").alias("v"), "l_returnflag")
    m = ChiSqSelector(input="v", output="o", label="l_returnflag", top=1).fit(df)
    return m.transform(df).select("l_orderkey", "l_linenumber", F.get("o", 0).alias("x"))


@query("ks_test", """WITH p AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n, (SELECT min(o_totalprice) FROM orders) AS a, (SELECT max(o_totalprice) FROM orders) AS b FROM orders)
  SELECT round(max(greatest(abs((v - a) / (b - a) - (r - 1) / n), abs(r / n - (v - a) / (b - a)))), 6) AS statistic, count(*) AS n FROM p""")
def _(t, spark):
    a, b = t("orders").agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return S.ks_test(t("orders"), "o_totalprice", lambda x: (x - a) / (b - a)).select(F.round("statistic", 6).alias("statistic"), "n")


@query("covariance", " UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, round(covar_samp({COLUMNS[i]}, {COLUMNS[j]}), 4) + 0.0::DOUBLE AS cov FROM lineitem" for i in range(4) for j in range(i, 4)))
def _(t, spark):
    return _rounded(S.covariance(t("lineitem"), COLUMNS), "i", "j", digits=4)


@query("top_by_key", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(t, spark):
    return S.top_by_key(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("sliding", """WITH p AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT i, value, lead(value, 1) OVER (ORDER BY i) AS b, lead(value, 2) OVER (ORDER BY i) AS c, lead(value, 3) OVER (ORDER BY i) AS d FROM p)
  SELECT i AS start, round(value, 6) AS x0, round(b, 6) AS x1, round(c, 6) AS x2, round(d, 6) AS x3 FROM w WHERE i % 2 = 0 AND i + 3 < (SELECT count(*) FROM events)""")
def _(t, spark):
    s = S.sliding(t("events"), "event_id", "value", 4, 2)
    return s.select("start", *[F.round(F.get("window", k), 6).alias(f"x{k}") for k in range(4)])


@query("auc", """WITH s AS (SELECT value AS v, (event_type = 'purchase' OR event_id % 3 = 0)::INT AS y FROM events), r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s)
  SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auc FROM r""")
def _(t, spark):
    df = t("events").select("value", ((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0)).cast("int").alias("y"))
    return _rounded(S.auc(df, "value", "y"))


@query("quantiles", "SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q, unnest(quantile_disc(l_extendedprice, [0.1, 0.5, 0.9])) AS value FROM lineitem")
def _(t, spark):
    return S.quantiles(t("lineitem"), "l_extendedprice", [0.1, 0.5, 0.9])


@query("quantile_sketch")
def _(t, spark):
    return S.kll_quantiles(t("lineitem"), "l_extendedprice", [0.1, 0.5, 0.9])


_SCORED = "SELECT o_orderkey, least(o_totalprice / 400000.0, 1.0) AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders"


def _scored(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.least(F.col("o_totalprice") / 400000.0, F.lit(1.0)).alias("p"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))


@query("binary_summary", f"""WITH s AS ({_SCORED}), c AS (SELECT sum((p > 0.5 AND y > 0)::INT)::BIGINT AS tp, sum((p > 0.5 AND y <= 0)::INT)::BIGINT AS fp, sum((p <= 0.5 AND y > 0)::INT)::BIGINT AS fn, sum((p <= 0.5 AND y <= 0)::INT)::BIGINT AS tn FROM s)
  SELECT tp, fp, fn, tn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2.0 * tp / (2 * tp + fp + fn), 6) AS f_beta, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def _(t, spark):
    return _rounded(E.binary_summary(_scored(t), "p", "y"), "tp", "fp", "fn", "tn")


@query("roc_points", f"""WITH s AS ({_SCORED}), b AS (SELECT least(floor(p * 100), 99)::BIGINT AS bin, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT bin, sum(pos) OVER w AS tp, sum(n) OVER w AS a, sum(pos) OVER () AS p, sum(n) OVER () AS t FROM b WINDOW w AS (ORDER BY bin DESC))
  SELECT bin, round((a - tp) / (t - p), 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / a, 6) AS precision FROM c""")
def _(t, spark):
    return _rounded(E.roc_points(_scored(t), "p", "y"), "bin")


@query("area_under_pr", f"""WITH s AS ({_SCORED}), b AS (SELECT least(floor(p * 1000), 999)::BIGINT AS bin, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT bin, sum(pos) OVER w AS tp, sum(n) OVER w AS a, sum(pos) OVER () AS p FROM b WINDOW w AS (ORDER BY bin DESC)), q AS (SELECT bin, tp / p AS r, tp / a AS pr FROM c)
  SELECT round(sum(a), 6) AS area FROM (SELECT (r - coalesce(lag(r) OVER w, 0)) * (pr + coalesce(lag(pr) OVER w, pr)) / 2 AS a FROM q WINDOW w AS (ORDER BY bin DESC))""")
def _(t, spark):
    return _rounded(E.area_under_pr(_scored(t), "p", "y"))


_CALLED = "SELECT o_orderstatus AS y, CASE WHEN o_totalprice < 100000 THEN 'F' WHEN o_totalprice < 250000 THEN 'O' ELSE 'P' END AS p FROM orders"


def _called(t) -> DataFrame:
    x = F.col("o_totalprice")
    return t("orders").select(F.col("o_orderstatus").alias("y"), F.when(x < 100000, "F").when(x < 250000, "O").otherwise("P").alias("p"))


_CLASSES = f"""WITH c AS ({_CALLED}), k AS (SELECT y AS class, count(*) AS n, sum((y = p)::INT)::BIGINT AS tp FROM c GROUP BY 1), m AS (SELECT p AS class, count(*) AS called FROM c GROUP BY 1),
  s AS (SELECT class, n, tp, coalesce(called, 0) AS called, (SELECT count(*) FROM c) AS total FROM k LEFT JOIN m USING (class)),
  f AS (SELECT class, n, tp, tp / n AS tpr, CASE WHEN total = n THEN 0.0 ELSE (called - tp) / (total - n) END AS fpr, CASE WHEN called = 0 THEN 0.0 ELSE tp / called END AS precision FROM s),
  g AS (SELECT *, CASE WHEN precision + tpr = 0 THEN 0.0 ELSE 2 * precision * tpr / (precision + tpr) END AS f1 FROM f) """


@query("multiclass_summary", _CLASSES + "SELECT class, n, tp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(tpr, 6) AS recall, round(f1, 6) AS f1 FROM g")
def _(t, spark):
    return _rounded(E.multiclass_summary(_called(t), "y", "p"), "class", "n", "tp")


@query("multiclass_weighted", _CLASSES + "SELECT round(sum(f1 * n) / sum(n), 6) AS f1, round(sum(precision * n) / sum(n), 6) AS weighted_precision, round(sum(tpr * n) / sum(n), 6) AS weighted_recall, round(sum(tp) / sum(n), 6) AS accuracy FROM g")
def _(t, spark):
    return _rounded(E.multiclass_weighted(_called(t), "y", "p"))


@query("confusion", f"WITH c AS ({_CALLED}) SELECT y AS label, p AS prediction, count(*) AS n FROM c GROUP BY ALL")
def _(t, spark):
    return E.confusion(_called(t), "y", "p")


@query("regression_summary", """WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
  SELECT count(*) AS n, round(avg(y), 3) AS label_mean, round(avg(p), 3) AS prediction_mean, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 5) AS r2, round(corr(y, p) * corr(y, p), 5) AS r2_fit, round(regr_slope(y, p), 5) AS slope, round(regr_intercept(y, p), 2) AS intercept, round(stddev_pop(y), 3) AS label_std FROM s""")
def _(t, spark):
    df = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    digits = {"label_mean": 3, "prediction_mean": 3, "rmse": 3, "mae": 3, "r2": 5, "r2_fit": 5, "slope": 5, "intercept": 2, "label_std": 3}
    return E.regression_summary(df, "y", "p").select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


_SILHOUETTE = """WITH v AS (SELECT vec_id, label AS c, {e} AS v FROM embeddings), p AS (SELECT a.vec_id, a.c, b.c AS o, sum({d}) AS s, count(*) AS n FROM v a JOIN v b ON TRUE GROUP BY 1, 2, 3),
  m AS (SELECT vec_id, max(CASE WHEN c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM p GROUP BY vec_id)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 5) AS silhouette FROM m"""


@query("silhouette", _SILHOUETTE.format(e="list_transform(embedding, lambda x: x::DOUBLE)", d="list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v)"))
def _(t, spark):
    return _rounded(E.silhouette(t("embeddings"), "embedding", "label"), digits=5)


@query("silhouette_cosine", _SILHOUETTE.format(e="list_transform(embedding, lambda x: x::DOUBLE)", d="1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"))
def _(t, spark):
    return _rounded(E.silhouette(t("embeddings"), "embedding", "label", cosine=True), digits=5)
