"""Evaluators: binary, multiclass, regression and clustering summaries as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.statistics import auc
from orrery.operators.stage import _Parameters


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def binary_summary(df: DataFrame, probability: str, label: str, threshold: float = 0.5, beta: float = 1.0) -> DataFrame:
    """One row: tp, fp, fn, tn, tpr, fpr, precision, recall, f_beta, accuracy."""
    p, y = F.col(probability) > threshold, F.col(label) > 0
    count = lambda c: F.sum(c.cast("long"))
    t = df.agg(count(p & y).alias("tp"), count(p & ~y).alias("fp"), count(~p & y).alias("fn"), count(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    b2 = beta * beta
    t = t.withColumns({"tpr": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn), "precision": _ratio(tp, tp + fp)})
    t = t.withColumn("recall", F.col("tpr"))
    f = _ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall"))
    return t.withColumns({"f_beta": f, "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})


def roc_points(df: DataFrame, probability: str, label: str, bins: int = 100) -> DataFrame:
    """(bin, fpr, tpr, precision) of thresholds at the lower edges of equal-width bins, highest first."""
    y = (F.col(label) > 0).cast("long")
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    counts = df.groupBy(b.alias("bin")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("bin"))  # at most ``bins`` rows
    every = Window.partitionBy()
    c = counts.withColumns({"tp": F.sum("pos").over(down), "all": F.sum("n").over(down), "p": F.sum("pos").over(every), "t": F.sum("n").over(every)})
    return c.select("bin", _ratio(F.col("all") - F.col("tp"), F.col("t") - F.col("p")).alias("fpr"), _ratio(F.col("tp"), F.col("p")).alias("tpr"), _ratio(F.col("tp"), F.col("all")).alias("precision"))


def area_under_pr(df: DataFrame, probability: str, label: str, bins: int = 1000) -> DataFrame:
    """One row (area): trapezoids between the bins' points, from recall 0 at the first precision."""
    w = Window.orderBy(F.desc("bin"))
    points = roc_points(df, probability, label, bins)
    last_r, last_p = F.coalesce(F.lag("tpr").over(w), F.lit(0.0)), F.coalesce(F.lag("precision").over(w), F.col("precision"))
    return points.withColumn("a", (F.col("tpr") - last_r) * (F.col("precision") + last_p) / 2).agg(F.sum("a").alias("area"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def multiclass_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, n, tpr, fpr, precision, recall, f1) of each class that is a label."""
    table = confusion(df, label, prediction)
    total = table.agg(F.sum("n").alias("total"))
    actual = table.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    called = table.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("called"))
    # one row for each class, and one with the total
    t = actual.join(called, "class", "left").join(F.broadcast(total)).fillna(0, ["called"])
    n, tp, m = F.col("n"), F.col("tp"), F.col("called")
    t = t.withColumns({"tpr": _ratio(tp, n), "fpr": _ratio(m - tp, F.col("total") - n), "precision": _ratio(tp, m), "recall": _ratio(tp, n)})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.withColumn("f1", f1).select("class", "n", "tpr", "fpr", "precision", "recall", "f1", "tp")


def multiclass_weighted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: f1, weighted_precision, weighted_recall (by class size) and accuracy."""
    s = multiclass_summary(df, label, prediction)
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return s.agg(mean("f1").alias("f1"), mean("precision").alias("weighted_precision"), mean("recall").alias("weighted_recall"), (F.sum("tp") / F.sum("n")).alias("accuracy"))


def regression_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: means, variances and deviations of both, explained_variance, mse, rmse, mae, r2 (of the
    predictions), r2_fit (squared correlation), slope and intercept. Pairs that aren't finite are left out."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.where(fine(y) & fine(p)).select(y.alias("y"), p.alias("p"))
    e = F.col("y") - F.col("p")
    a = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("label_mean"), F.avg("p").alias("prediction_mean"), F.var_pop("y").alias("label_var"), F.var_pop("p").alias("prediction_var"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.regr_slope(F.col("y"), F.col("p")).alias("slope"), F.regr_intercept(F.col("y"), F.col("p")).alias("intercept"),
        F.corr("y", "p").alias("c"), F.avg((F.col("p")) * F.col("p")).alias("pp"),
    )
    explained = F.col("pp") - 2 * F.col("label_mean") * F.col("prediction_mean") + F.col("label_mean") * F.col("label_mean")
    return a.withColumns({
        "label_std": F.sqrt("label_var"), "prediction_std": F.sqrt("prediction_var"), "rmse": F.sqrt("mse"), "r2": 1 - F.col("mse") / F.col("label_var"),
        "r2_fit": F.col("c") * F.col("c"), "explained_variance": explained,
    }).drop("c", "pp")


def silhouette(df: DataFrame, vector: str, cluster: str, cosine: bool = False) -> DataFrame:
    """One row (silhouette): mean over all points with squared Euclidean or cosine distance, in
    closed form from the clusters' sums: sum over c of |x - y|^2 = n|x|^2 + sum |y|^2 - 2 x . sum y."""
    v = F.transform(vector, lambda x: x.cast("double"))
    if cosine:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        v = F.transform(v, lambda x: x / norm)
    rows = df.select(F.col(cluster).alias("c"), v.alias("v")).withColumn("q", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    parts = rows.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    size = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    table = sums.join(size, "c").agg(F.collect_list(F.struct("c", "n", "q", F.transform("s", lambda e: e.x).alias("s"))).alias("t"))
    # a row for each cluster, broadcast as one array
    rows = rows.join(F.broadcast(table))
    inner = lambda s: F.aggregate(F.zip_with("v", s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    total = lambda t: (t.n * F.col("q") + t.q - 2 * inner(t.s)) / (2.0 if cosine else 1.0)
    mine = F.get(F.filter("t", lambda t: t.c == F.col("c")), 0)
    rows = rows.withColumn("mine", mine)
    own = F.when(F.col("mine.n") > 1, total(F.col("mine")) / (F.col("mine.n") - 1))
    other = F.array_min(F.transform(F.filter("t", lambda t: t.c != F.col("c")), lambda t: total(t) / t.n))
    rows = rows.select(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b")).when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0)
    return rows.agg(F.avg(s).alias("silhouette"))


class _Evaluator(_Parameters):
    def __init__(self, **values) -> None:
        self._declare(values)


class BinaryClassificationEvaluator(_Evaluator):
    params = {"label": "label", "probability": "probability", "metric": "areaUnderROC"}

    def evaluate(self, df: DataFrame) -> float:
        f = {"areaUnderROC": lambda: auc(df, self.probability, self.label), "areaUnderPR": lambda: area_under_pr(df, self.probability, self.label)}
        return f[self.metric]().first()[0]


class MulticlassClassificationEvaluator(_Evaluator):
    params = {"label": "label", "prediction": "prediction", "metric": "f1"}

    def evaluate(self, df: DataFrame) -> float:
        names = {"f1": "f1", "weightedPrecision": "weighted_precision", "weightedRecall": "weighted_recall", "accuracy": "accuracy"}
        return multiclass_weighted(df, self.label, self.prediction).first()[names[self.metric]]


class RegressionEvaluator(_Evaluator):
    params = {"label": "label", "prediction": "prediction", "metric": "rmse"}

    def evaluate(self, df: DataFrame) -> float:
        return regression_summary(df, self.label, self.prediction).first()[self.metric]


class ClusteringEvaluator(_Evaluator):
    params = {"features": "features", "prediction": "prediction", "distance": "squaredEuclidean"}

    def evaluate(self, df: DataFrame) -> float:
        return silhouette(df, self.features, self.prediction, self.distance == "cosine").first()[0]
