"""Generalized linear models, factorization machines and online FTRL on the parameter table.

Examples come in long form: (row_id, idx, value) entries and (row_id, label[, weight]). A step is
pull (join on idx), a grouped sum for each row's score, the loss's derivative, and push (grouped
sum for each index). Partial aggregation before each shuffle keeps frequent indexes apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import params_table as P
from orrery.operators.stage import Fitter, Stage
from orrery.plans.storage import cut


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def loss_and_slope(kind: str, score: Column, y: Column, delta: float = 1.0) -> tuple[Column, Column]:
    """Loss of a score and its derivative. Labels of log and hinge loss are positive or not."""
    s = F.when(y > 0, 1.0).otherwise(-1.0)
    if kind == "logloss":
        m = s * score
        return F.when(m > 0, F.log1p(F.exp(-m))).otherwise(-m + F.log1p(F.exp(m))), -s * sigmoid(-m)
    if kind == "hingeloss":
        return F.greatest(F.lit(0.0), 1 - s * score), F.when(s * score < 1, -s).otherwise(0.0)
    e = score - y
    if kind == "l2loss":
        return 0.5 * e * e, e
    if kind == "huberloss":
        return F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta)), F.greatest(F.lit(-delta), F.least(F.lit(delta), e))
    raise ValueError(f"unknown loss {kind}")


def scores(entries: DataFrame, labels: DataFrame, table: DataFrame, bias: float = 0.0) -> DataFrame:
    """(row_id, label, ..., score) for every labelled row."""
    s = P.pull(entries, table.select("idx", "value").withColumnRenamed("value", "w"))
    s = s.groupBy("row_id").agg(F.sum(F.col("w") * F.col("value")).alias("score"))
    return labels.join(s, "row_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.lit(bias))


def gradient(entries: DataFrame, scored: DataFrame, loss: str, delta: float = 1.0) -> DataFrame:
    """(idx, grad): mean gradient over the (weighted) rows."""
    w = F.col("weight") if "weight" in scored.columns else F.lit(1.0)
    total = scored.agg(F.sum(w).alias("total")).first()[0] or 1.0
    slope = loss_and_slope(loss, F.col("score"), F.col("label"), delta)[1]
    g = scored.select("row_id", (slope * w / total).alias("g"))
    return entries.join(g, "row_id").groupBy("idx").agg(F.sum(F.col("value") * F.col("g")).alias("grad"))


def fit_linear(entries: DataFrame, labels: DataFrame, loss: str = "logloss", rate: float = 0.1, epochs: int = 3, optimizer: str = "sgd", decay: str = "none", l2: float = 0.0, batches: int = 1, init: DataFrame | None = None, **more) -> tuple[DataFrame, list[float]]:
    """(parameter table, loss before each epoch). With ``batches`` over 1, rows are dealt to
    mini-batches by a hash of their id."""
    table = init if init is not None else cut(P.zeros(entries, "value"), "params")
    history, k = [], 0
    for epoch in range(epochs):
        for b in range(batches):
            part = labels if batches == 1 else labels.where(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == b)
            scored = cut(scores(entries, part, table), "scores")
            if b == 0:
                history.append(scored.agg(F.avg(loss_and_slope(loss, F.col("score"), F.col("label"))[0])).first()[0])
            g = gradient(entries, scored, loss)
            if l2:
                g = g.join(table.select("idx", "value"), "idx").select("idx", (F.col("grad") + l2 * F.col("value")).alias("grad"))
            k += 1
            rule = P.OPTIMIZERS[optimizer](P.decayed(decay, rate, epoch), **more)
            table = P.train_step(table, g, rule, k)
    return table, history


def fit_softmax(entries: DataFrame, labels: DataFrame, classes: int, rate: float = 0.1, epochs: int = 3) -> DataFrame:
    """(idx, class, value) of multinomial logistic regression, full-batch steps."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class")
    table = cut(P.zeros(entries, "value").select("idx", ks, "value"), "params")
    n = labels.count()
    for _ in range(epochs):
        s = softmax_scores(entries, labels, table, classes)
        g = s.select("row_id", "class", ((F.col("p") - (F.col("label") == F.col("class")).cast("double")) / n).alias("g"))
        g = entries.join(g, "row_id").groupBy("idx", "class").agg(F.sum(F.col("value") * F.col("g")).alias("grad"))
        table = cut(table.join(g, ["idx", "class"], "left").select("idx", "class", (F.col("value") - rate * F.coalesce("grad", F.lit(0.0))).alias("value")), "params")
    return table


def softmax_scores(entries: DataFrame, labels: DataFrame, table: DataFrame, classes: int) -> DataFrame:
    """(row_id, label, class, p)."""
    s = entries.join(table.withColumnRenamed("value", "w"), "idx").groupBy("row_id", "class").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    every = labels.select("row_id", "label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"))
    s = every.join(s, ["row_id", "class"], "left").fillna(0.0, ["s"])
    total = s.groupBy("row_id").agg(F.max("s").alias("top"), F.collect_list("s").alias("all"))  # one number for each class
    return s.join(total, "row_id").select("row_id", "label", "class", (F.exp(F.col("s") - F.col("top")) / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("p"))


def fm_scores(entries: DataFrame, table: DataFrame, factors: DataFrame, bias: float = 0.0) -> DataFrame:
    """(row_id, score): w . x + half the sum over factors of (sum v x)^2 - sum (v x)^2."""
    linear = entries.join(table.select("idx", F.col("value").alias("w")), "idx").groupBy("row_id").agg(F.sum(F.col("w") * F.col("value")).alias("linear"))
    vx = entries.join(factors.select("idx", "f", F.col("value").alias("v")), "idx").withColumn("vx", F.col("v") * F.col("value"))
    pair = vx.groupBy("row_id", "f").agg(F.sum("vx").alias("s"), F.sum(F.col("vx") * F.col("vx")).alias("q"))
    pair = pair.groupBy("row_id").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("pair"))
    return linear.join(pair, "row_id", "full").select("row_id", (F.lit(bias) + F.coalesce("linear", F.lit(0.0)) + F.coalesce("pair", F.lit(0.0))).alias("score"))


def fit_fm(entries: DataFrame, labels: DataFrame, k: int = 8, loss: str = "logloss", rate: float = 0.1, epochs: int = 5, scale: float = 0.01, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """(linear table, factor table (idx, f, value), loss history), full-batch steps."""
    from orrery.operators.tuning import uniform

    table = cut(P.zeros(entries, "value"), "params")
    fs = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f")
    factors = table.select("idx", fs)
    factors = cut(factors.withColumn("value", (uniform(seed, "idx", "f") * 2 - 1) * scale), "factors")
    n, history = labels.count(), []
    for _ in range(epochs):
        scored = cut(labels.join(fm_scores(entries, table, factors), "row_id", "left").fillna(0.0, ["score"]), "scores")
        loss_of, slope = loss_and_slope(loss, F.col("score"), F.col("label"))
        history.append(scored.agg(F.avg(loss_of)).first()[0])
        g = entries.join(scored.select("row_id", (slope / n).alias("g")), "row_id")
        dw = g.groupBy("idx").agg(F.sum(F.col("value") * F.col("g")).alias("grad"))
        vx = g.join(factors.select("idx", "f", F.col("value").alias("v")), "idx")
        sums = vx.groupBy("row_id", "f").agg(F.sum(F.col("v") * F.col("value")).alias("s"))
        x = F.col("value")
        dv = vx.join(sums, ["row_id", "f"]).groupBy("idx", "f").agg(F.sum(F.col("g") * (x * F.col("s") - F.col("v") * x * x)).alias("grad"))
        table = cut(table.join(dw, "idx", "left").select("idx", (F.col("value") - rate * F.coalesce("grad", F.lit(0.0))).alias("value")), "params")
        factors = cut(factors.join(dv, ["idx", "f"], "left").select("idx", "f", (F.col("value") - rate * F.coalesce("grad", F.lit(0.0))).alias("value")), "factors")
    return table, factors, history


def ftrl_batch(state: DataFrame, entries: DataFrame, labels: DataFrame, alpha: float = 0.1, beta: float = 1.0, lambda1: float = 0.1, lambda2: float = 0.1) -> DataFrame:
    """The state (idx, z, n) after one batch: every example of it sees the weights from before."""
    w = state.select("idx", "n", P.ftrl_weight(F.col("z"), F.col("n"), alpha, beta, lambda1, lambda2).alias("w"))
    pulled = P.pull(entries, w)
    p = pulled.groupBy("row_id").agg(sigmoid(F.sum(F.col("w") * F.col("value"))).alias("p"))
    err = labels.join(p, "row_id", "left").select("row_id", (F.coalesce("p", F.lit(0.5)) - F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("e"))
    g = pulled.join(err, "row_id").withColumn("g", F.col("e") * F.col("value"))
    dz = F.col("g") - (F.sqrt(F.col("n") + F.col("g") * F.col("g")) - F.sqrt("n")) / alpha * F.col("w")
    delta = g.select("idx", dz.alias("dz"), (F.col("g") * F.col("g")).alias("dn")).groupBy("idx").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn"))
    out = state.join(delta, "idx", "full").fillna(0.0)
    return out.select("idx", (F.col("z") + F.col("dz")).alias("z"), (F.col("n") + F.col("dn")).alias("n"))


def ftrl_weights(state: DataFrame, alpha: float = 0.1, beta: float = 1.0, lambda1: float = 0.1, lambda2: float = 0.1) -> DataFrame:
    """(idx, value) without negligible weights."""
    return state.select("idx", P.ftrl_weight(F.col("z"), F.col("n"), alpha, beta, lambda1, lambda2).alias("value")).where("abs(value) >= 1e-11")


def ftrl_fm_batch(state: DataFrame, factors: DataFrame, entries: DataFrame, labels: DataFrame, alpha: float = 0.1, beta: float = 1.0, lambda1: float = 0.1, lambda2: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """FTRL for the linear part (idx, z, n) and for latent factors (idx, f, z, n) of one batch."""
    weight = lambda s: P.ftrl_weight(F.col("z"), F.col("n"), alpha, beta, lambda1, lambda2).alias(s)
    w, v = state.select("idx", weight("value")), factors.select("idx", "f", P.ftrl_weight(F.col("z"), F.col("n"), alpha, beta, 0.0, lambda2).alias("value"))
    err = labels.join(fm_scores(entries, w, v), "row_id", "left").select("row_id", (sigmoid(F.coalesce("score", F.lit(0.0))) - F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("e"))
    vx = entries.join(v.withColumnRenamed("value", "v"), "idx")
    sums = vx.groupBy("row_id", "f").agg(F.sum(F.col("v") * F.col("value")).alias("s"))
    x = F.col("value")
    g = vx.join(sums, ["row_id", "f"]).join(err, "row_id").withColumn("g", F.col("e") * (x * F.col("s") - F.col("v") * x * x))
    old = g.join(factors.select("idx", "f", "n"), ["idx", "f"])
    dz = F.col("g") - (F.sqrt(F.col("n") + F.col("g") * F.col("g")) - F.sqrt("n")) / alpha * F.col("v")
    delta = old.groupBy("idx", "f").agg(F.sum(dz).alias("dz"), F.sum(F.col("g") * F.col("g")).alias("dn"))
    new = factors.join(delta, ["idx", "f"], "left").fillna(0.0, ["dz", "dn"]).select("idx", "f", (F.col("z") + F.col("dz")).alias("z"), (F.col("n") + F.col("dn")).alias("n"))
    return ftrl_batch(state, entries, labels, alpha, beta, lambda1, lambda2), new


class LinearModel(Stage):
    """Scores dense vectors with inlined weights; adds raw, probability and prediction."""

    params = {"features": "features", "weights": [], "bias": 0.0, "loss": "logloss", "raw": "raw", "probability": "probability", "prediction": "prediction"}

    def apply(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        df = df.withColumn(self.raw, F.lit(self.bias) + F.aggregate(F.zip_with(self.features, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
        if self.loss not in ("logloss", "hingeloss"):
            return df.withColumn(self.prediction, F.col(self.raw))
        return df.withColumn(self.probability, sigmoid(F.col(self.raw))).withColumn(self.prediction, (F.col(self.raw) > 0).cast("double"))


class LinearLearner(Fitter):
    """Full-batch training on dense vectors; the weights of each step are an array literal, so a
    step is one scan and one aggregation. Vectors of more than ``params_table.INLINE`` components
    belong into ``fit_linear``."""

    params = {"features": "features", "label": "label", "weight": None, "loss": "logloss", "rate": 0.5, "epochs": 20, "l2": 0.0, "decay": "none", "fit_bias": True, "raw": "raw", "probability": "probability", "prediction": "prediction"}

    def learn(self, df: DataFrame) -> LinearModel:
        d = df.select(F.max(F.size(self.features))).first()[0] or 0
        if d > P.INLINE:
            raise ValueError("too wide for inlined weights; use fit_linear on long entries")
        w, bias = [0.0] * d, 0.0
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        for epoch in range(self.epochs):
            m = LinearModel(features=self.features, weights=w, bias=bias, loss="l2loss", raw="__raw", prediction="__p")
            slope = loss_and_slope(self.loss, F.col("__raw"), F.col(self.label).cast("double"))[1] * weight
            scored = m.apply(df).select(self.features, slope.alias("g"), weight.alias("wt"))
            row = scored.agg(F.sum("wt").alias("n"), F.sum("g").alias("b"), *[F.sum(F.element_at(self.features, i + 1) * F.col("g")).alias(f"g{i}") for i in range(d)]).first()
            rate = P.decayed(self.decay, self.rate, epoch)
            w = [x - rate * (row[f"g{i}"] / row.n + self.l2 * x) for i, x in enumerate(w)]
            bias = bias - rate * row.b / row.n if self.fit_bias else 0.0
        return LinearModel(features=self.features, weights=w, bias=bias, loss=self.loss, raw=self.raw, probability=self.probability, prediction=self.prediction)


class OneVsRestModel(Stage):
    params = {"features": "features", "models": [], "prediction": "prediction"}

    def apply(self, df: DataFrame) -> DataFrame:
        scores_ = [F.lit(m["bias"]) + F.aggregate(F.zip_with(self.features, F.array(*[F.lit(x) for x in m["weights"]]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) for m in self.models]
        return df.withColumn("__s", F.array(*scores_)).withColumn(self.prediction, (F.array_position("__s", F.array_max("__s")) - 1).cast("double")).drop("__s")


class OneVsRest(Fitter):
    """One binary learner for each class 0..K-1; prediction is the class with the greatest raw score."""

    params = {"features": "features", "label": "label", "classes": 2, "prediction": "prediction", "rate": 0.5, "epochs": 20}

    def learn(self, df: DataFrame) -> OneVsRestModel:
        models = []
        for k in range(self.classes):
            one = df.withColumn("__y", (F.col(self.label) == k).cast("double"))
            m = LinearLearner(features=self.features, label="__y", rate=self.rate, epochs=self.epochs).learn(one)
            models.append({"weights": m.weights, "bias": m.bias})
        return OneVsRestModel(features=self.features, models=models, prediction=self.prediction)
