"""Histogram-based gradient boosting on a long table of binned entries.

Binned entries are kept as one map of feature to bin for each row, written once beside the labels and, with each
tree, the new scores. A level's histogram is one grouped sum over (node, feature, bin) of that table, combined before its
shuffle: a row's node is an expression over its map, so rows are neither joined nor moved. Only the smaller child of
a split is summed, its sibling is the parent minus it. Splits come from prefix sums over a feature's bins, for
features of few values from a greedy division of the bins; trees are small tables that compile to SQL for scoring.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.tuning import uniform
from orrery.plans.storage import cut, drop_cut, small_side


def candidate_splits(entries: DataFrame, num_splits: int = 20, few: int = 16) -> DataFrame:
    """(fid, categorical, splits): all values of features with at most ``few`` of them, else
    distinct quantiles; a feature of one value gets a second point beyond it."""
    counts = entries.groupBy("fid", "value").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("fid").agg(F.count("*").alias("kinds"))
    small = counts.join(sizes.where(F.col("kinds") <= few), "fid").groupBy("fid").agg(F.array_sort(F.collect_set("value")).alias("splits"))
    at = [k / num_splits for k in range(num_splits)]
    large = entries.join(sizes.where(F.col("kinds") > few).select("fid"), "fid", "left_semi").groupBy("fid").agg(F.percentile_approx("value", at, 1000).alias("q"))
    large = large.select("fid", F.lit(False).alias("categorical"), F.array_distinct("q").alias("splits"))
    both = small.select("fid", F.lit(True).alias("categorical"), "splits").union(large)
    return both.withColumn("splits", F.when(F.size("splits") == 1, F.array(F.get("splits", 0), F.get("splits", 0) + 1)).otherwise(F.col("splits")))


def binned(entries: DataFrame, splits: DataFrame) -> DataFrame:
    """(row_id, fid, bin): the number of split points at or below the value, minus one, at least 0."""
    e = entries.join(small_side(splits, 100_000), "fid")
    return e.select("row_id", "fid", F.greatest(F.size(F.filter("splits", lambda s: s <= F.col("value"))) - 1, F.lit(0)).alias("bin"))


def gradients(kind: str, score: Column, y: Column) -> tuple[Column, Column]:
    """First and second derivative: binary logistic (labels 0 and 1) or squared error."""
    if kind == "logistic":
        p = 1 / (1 + F.exp(-score))
        return p - y, F.greatest(p * (1 - p), F.lit(1e-16))
    if kind == "squared":
        return score - y, F.lit(1.0)
    raise ValueError(f"unknown objective {kind}")


def multinomial_gradients(scores: Column, y: Column, classes: int, full: bool = False) -> tuple[list[Column], list[Column]]:
    """Derivatives of the softmax loss by each class's score: one first derivative for each class, and as second
    derivatives the diagonal or, if ``full``, the upper triangle of the Hessian by rows."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    p = [F.get(weights, k) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) for k in range(classes)]
    g = [p[k] - (y == k).cast("double") for k in range(classes)]
    if not full:
        return g, [F.greatest(x * (1 - x), F.lit(1e-16)) for x in p]
    return g, [F.greatest(p[i] * (1 - p[i]), F.lit(1e-16)) if i == j else -p[i] * p[j] for i in range(classes) for j in range(i, classes)]


def histogram(bins: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, fid, bin, g, h) for rows (row_id, node, g, h)."""
    return bins.join(rows, "row_id").groupBy("node", "fid", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def node_gain(g: Column, h: Column, reg_lambda: float, alpha: float = 0.0) -> Column:
    t = F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))
    return t * t / (h + reg_lambda)


def best_splits(hist: DataFrame, totals: DataFrame, reg_lambda: float = 1.0, alpha: float = 0.0, min_child: float = 0.0, min_gain: float = 0.0, absent_right: DataFrame | None = None) -> DataFrame:
    """(node, fid, bin, gain, gl, hl) of each node's best split "bin <= b goes left"; rows without
    an entry of the feature go left, but right at the (fid, bin) of ``absent_right``. gain = G_L + G_R - G - lambda. Ties: smallest
    feature, then bin."""
    present = hist.groupBy("node", "fid").agg(F.sum("g").alias("pg"), F.sum("h").alias("ph"))
    h = hist.join(present, ["node", "fid"]).join(totals.toDF("node", "tg", "th"), "node")
    w = Window.partitionBy("node", "fid").orderBy("bin")
    goes_left = F.lit(1.0)
    if absent_right is not None:
        h = h.join(F.broadcast(absent_right.withColumn("right", F.lit(True))), ["fid", "bin"], "left")
        goes_left = F.when(F.col("right"), 0.0).otherwise(1.0)
    gl = F.sum("g").over(w) + goes_left * (F.col("tg") - F.col("pg"))
    hl = F.sum("h").over(w) + goes_left * (F.col("th") - F.col("ph"))
    s = h.select("node", "fid", "bin", gl.alias("gl"), hl.alias("hl"), "tg", "th")
    gr, hr = F.col("tg") - F.col("gl"), F.col("th") - F.col("hl")
    gain = node_gain(F.col("gl"), F.col("hl"), reg_lambda, alpha) + node_gain(gr, hr, reg_lambda, alpha) - node_gain(F.col("tg"), F.col("th"), reg_lambda, alpha) - reg_lambda
    ok = (F.col("hl") > 0) & (hr > 1e-12) & (F.col("hl") >= min_child) & (hr >= min_child)
    s = s.where(ok).withColumn("gain", gain).where(F.col("gain") > min_gain)
    top = s.groupBy("node").agg(F.max(F.struct("gain", (-F.col("fid")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")).alias("t"))
    return top.select("node", (-F.col("t.f")).alias("fid"), (-F.col("t.b")).alias("bin"), F.col("t.gain").alias("gain"), F.col("t.gl").alias("gl"), F.col("t.hl").alias("hl"))


def leaf_weight(g: float, h: float, reg_lambda: float, alpha: float = 0.0, max_weight: float = 0.0) -> float:
    t = math.copysign(max(abs(g) - alpha, 0.0), g)
    w = -t / (h + reg_lambda)
    return max(-max_weight, min(max_weight, w)) if max_weight > 0 else w


def _matrix(h: np.ndarray, size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle, or a diagonal one."""
    if len(h) == size:
        return np.diag(h)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = h
    return out + np.triu(out, 1).T


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def vector_gain(g: np.ndarray, h: np.ndarray, reg_lambda: float, alpha: float = 0.0) -> float:
    """g' (H + lambda)^-1 g of a node, for a diagonal or a full Hessian."""
    t = _shrunk(g, alpha)
    if len(h) == len(g):
        return float((t * t / (h + reg_lambda)).sum())
    return float(t @ np.linalg.solve(_matrix(h, len(g)) + reg_lambda * np.eye(len(g)), t))


def vector_weight(g: np.ndarray, h: np.ndarray, reg_lambda: float, alpha: float = 0.0, max_weight: float = 0.0) -> list[float]:
    t = _shrunk(g, alpha)
    if len(h) == len(g):
        w = -t / (h + reg_lambda)
    else:
        low = np.linalg.cholesky(_matrix(h, len(g)) + reg_lambda * np.eye(len(g)))
        w = -np.linalg.solve(low.T, np.linalg.solve(low, t))
    return [float(x) for x in (np.clip(w, -max_weight, max_weight) if max_weight > 0 else w)]


def scan_bins(bins: np.ndarray, g: np.ndarray, h: np.ndarray, total_g: np.ndarray, total_h: np.ndarray, default: int | None, absent_right: frozenset, settings: Settings) -> tuple | None:
    """A node's best split of one feature from its bins' sums (rows of ``g`` and ``h``, in the order of ``bins``): (gain, bin,
    left bins or None, left g, left h), or None. Rows without an entry are what the totals have beyond the bins.

    With a ``default`` bin the feature is one of categories: that bin and absent rows go left, and each other bin in
    turn goes left if its gradient agrees with the left sum more than with the right. Else "bin <= b goes left" for the best b, absent
    rows left but for the bins of ``absent_right``."""
    whole = vector_gain(total_g, total_h, settings.reg_lambda, settings.alpha)
    size = len(total_g)

    def judged(gl: np.ndarray, hl: np.ndarray) -> float | None:
        diagonals = [np.diag(_matrix(x, size)) for x in (hl, total_h - hl)]
        if any((d <= 1e-12).any() or d.sum() < settings.min_child for d in diagonals):
            return None
        gain = vector_gain(gl, hl, settings.reg_lambda, settings.alpha) + vector_gain(total_g - gl, total_h - hl, settings.reg_lambda, settings.alpha) - whole - settings.reg_lambda
        return gain if gain > settings.min_gain else None

    rest_g, rest_h = total_g - g.sum(0), total_h - h.sum(0)
    if default is not None:
        left, gl, hl = {default}, rest_g + g[bins == default].sum(0), rest_h + h[bins == default].sum(0)
        for b, x, y in zip(bins, g, h, strict=True):
            if b != default and float(x @ (2 * gl + x - total_g)) >= 0:
                left.add(int(b))
                gl, hl = gl + x, hl + y
        if left >= {int(b) for b in bins}:
            return None
        gain = judged(gl, hl)
        return None if gain is None else (gain, -1, sorted(left), gl, hl)
    best, gl, hl = None, np.zeros(size), np.zeros(h.shape[1])
    for b, x, y in zip(bins, g, h, strict=True):
        gl, hl = gl + x, hl + y
        own_g, own_h = (gl, hl) if int(b) in absent_right else (gl + rest_g, hl + rest_h)
        gain = judged(own_g, own_h)
        if gain is not None and (best is None or gain > best[0]):
            best = (gain, int(b), None, own_g, own_h)
    return best


def scanned_splits(hist: DataFrame, gs: list[str], hs: list[str], sums: dict, categorical: dict[int, int], absent_right: dict[int, frozenset], settings: Settings) -> DataFrame:
    """(node, fid, gain, bin, left, hl) of ``scan_bins`` for each node and feature of a histogram. ``sums``: node ->
    (first, second derivatives); ``categorical``: fid -> default bin."""

    def scanned(key, pdf: pd.DataFrame) -> pd.DataFrame:
        node, fid = int(key[0]), int(key[1])
        pdf = pdf.sort_values("bin")
        got = scan_bins(pdf.bin.to_numpy(), pdf[gs].to_numpy(float), pdf[hs].to_numpy(float), *sums[node], categorical.get(fid), absent_right.get(fid, frozenset()), settings)
        made = [] if got is None else [(node, fid, got[0], got[1], got[2], float(np.trace(_matrix(got[4], len(gs)))))]
        return pd.DataFrame(made, columns=["node", "fid", "gain", "bin", "left", "hl"])

    return hist.groupBy("node", "fid").applyInPandas(scanned, "node int, fid int, gain double, bin int, left array<int>, hl double")


@dataclass
class Settings:
    """Of one tree: how it grows and what counts as a split."""

    depth: int = 6
    reg_lambda: float = 1.0
    alpha: float = 0.0
    min_child: float = 0.0
    min_gain: float = 0.0
    max_leaves: int = 0
    max_weight: float = 0.0
    min_rows: int = 0


@dataclass
class Tree:
    """splits: node -> (fid, bin, threshold, gain); leaves: node -> weight, or a weight for each class. Children of n:
    2n+1, 2n+2. Absent values go left iff the threshold is above 0. ``sets``: node -> (split points, bins that go left) of
    a feature of categories, whose absent values go left."""

    splits: dict[int, tuple] = field(default_factory=dict)
    leaves: dict[int, float | list[float]] = field(default_factory=dict)
    sets: dict[int, tuple] = field(default_factory=dict)

    def expression(self, value, node: int = 0) -> Column:
        """The tree as nested conditions; ``value(fid)`` is a feature's column (absent: null)."""
        if node in self.leaves:
            return F.lit(self.leaves[node])
        fid, _, threshold, _ = self.splits[node]
        x = value(fid)
        if node in self.sets:
            points, left = self.sets[node]
            at = F.greatest(F.size(F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: p <= x)) - 1, F.lit(0))
            goes = F.when(x.isNull(), True).otherwise(at.isin(*left))
        else:
            goes = F.when(x.isNull(), threshold > 0).otherwise(x < threshold)
        return F.when(goes, self.expression(value, 2 * node + 1)).otherwise(self.expression(value, 2 * node + 2))

    def placed(self, bins: Column, made, node: int = 0) -> Column:
        """``made(leaf)`` of the leaf, or open node, that a map of bins leads to."""
        if node not in self.splits:
            return made(node)
        fid, cut_at, threshold, _ = self.splits[node]
        at = F.try_element_at(bins, F.lit(fid))
        goes = F.when(at.isNull(), True).otherwise(at.isin(*self.sets[node][1])) if node in self.sets else F.when(at.isNull(), threshold > 0).otherwise(at <= cut_at)
        return F.when(goes, self.placed(bins, made, 2 * node + 1)).otherwise(self.placed(bins, made, 2 * node + 2))


@dataclass
class BoostedModel:
    trees: list[Tree]
    rate: float
    base: float = 0.0
    history: list[float] = field(default_factory=list)
    classes: int = 0

    def score(self, value) -> Column:
        """The raw score; an array of one for each class of a multinomial model."""
        if self.classes:
            trees = [t.expression(value) for t in self.trees]
            return F.array(*[reduce(lambda a, b: a + b, [F.lit(self.rate) * F.get(t, k) for t in trees], F.lit(self.base)) for k in range(self.classes)])
        return reduce(lambda a, t: a + F.lit(self.rate) * t.expression(value), self.trees, F.lit(self.base))

    def predict(self, value, objective: str = "logistic") -> Column:
        """The class (of greatest score; of two, 1 for a positive score), or the score of a regression."""
        s = self.score(value)
        if self.classes:
            return (F.array_position(s, F.array_max(s)) - 1).cast("double")
        return s if objective == "squared" else (s > 0).cast("double")

    def importance(self) -> dict[int, tuple[int, float, float]]:
        """fid -> (number of splits, mean gain, total gain)."""
        out: dict[int, list[float]] = {}
        for t in self.trees:
            for fid, _, _, gain in t.splits.values():
                out.setdefault(fid, []).append(gain)
        return {f: (len(g), sum(g) / len(g), sum(g)) for f, g in sorted(out.items())}

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line for the model and one for each tree."""
        head = json.dumps({"rate": self.rate, "base": self.base, "history": self.history, "classes": self.classes})
        rows = [(-1, head)] + [(i, json.dumps({k: list(d.items()) for k, d in (("splits", t.splits), ("leaves", t.leaves), ("sets", {n: (list(p), sorted(x)) for n, (p, x) in t.sets.items()}))})) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        head, *trees = (json.loads(r.body) for r in spark.read.parquet(path).orderBy("tree").collect())
        made = [Tree({n: tuple(x) for n, x in t["splits"]}, dict(map(tuple, t["leaves"])), {n: (tuple(p), frozenset(x)) for n, (p, x) in t["sets"]}) for t in trees]
        return BoostedModel(made, head["rate"], head["base"], head["history"], head["classes"])


METRICS = ("rmse", "error", "precision", "log-loss", "cross-entropy", "auc")


def metric(df: DataFrame, kind: str, classes: int = 0) -> float:
    """A model's metric over (label, score): rmse (the mean squared error, as usual for this name), error and precision
    (shares of wrong and right classes), log-loss (of two classes), cross-entropy (of several), auc."""
    y, s = F.col("label").cast("double"), F.col("score")
    if kind == "auc":
        from orrery.operators.statistics import auc

        return auc(df, "score", "label").first()[0]
    if kind in ("error", "precision"):
        called = (F.array_position(s, F.array_max(s)) - 1).cast("double") if classes else (s > 0).cast("double")
        right = df.agg(F.avg((called == y).cast("double"))).first()[0]
        return right if kind == "precision" else 1 - right
    if kind == "rmse":
        e = (s - y) * (s - y)
    elif kind == "log-loss":
        z = -s * F.when(y > 0, 1.0).otherwise(-1.0)
        e = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    elif kind == "cross-entropy":
        top = F.array_max(s)
        e = top + F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))) - F.get(s, y.cast("int"))
    else:
        raise ValueError(f"metric is one of {METRICS}, not {kind!r}")
    return df.agg(F.avg(e)).first()[0]


@dataclass
class _Level:
    """What a tree's growth knows of an open node: sums, rows, and its best split."""

    g: np.ndarray
    h: np.ndarray
    rows: int
    split: tuple | None = None


class _Grower:
    """Grows one tree over ``data`` (bins, and columns g0.., h0..)."""

    def __init__(self, data: DataFrame, thresholds: dict, categorical: dict[int, int], fids: frozenset | None, settings: Settings, dims: tuple[int, int]) -> None:
        self.data, self.thresholds, self.categorical, self.fids, self.settings = data, thresholds, categorical, fids, settings
        self.gs, self.hs = [f"g{k}" for k in range(dims[0])], [f"h{k}" for k in range(dims[1])]
        self.tree, self.open, self.hist = Tree(), {}, None

    def histogram(self, nodes: list[int]) -> DataFrame:
        """(node, fid, bin, g.., h.., n) of some open nodes; fid -1 counts whole rows."""
        inside = set(nodes)
        node = self.tree.placed(F.col("bins"), lambda n: F.lit(n) if n in inside else F.lit(None).cast("int"))
        entries = F.map_entries("bins")
        if self.fids is not None:
            entries = F.filter(entries, lambda e: e.key.isin(*self.fids))
        every = F.array_prepend(entries, F.struct(F.lit(-1).alias("key"), F.lit(0).alias("value")))
        rows = self.data.select(node.alias("node"), every.alias("e"), *self.gs, *self.hs).where("node is not null")
        rows = rows.select("node", F.explode("e").alias("e"), *self.gs, *self.hs)
        sums = [F.sum(c).alias(c) for c in (*self.gs, *self.hs)]
        return rows.groupBy("node", F.col("e.key").alias("fid"), F.col("e.value").alias("bin")).agg(*sums, F.count("*").alias("n"))

    def search(self, nodes: list[int]) -> None:
        """Sets sums and best splits of ``nodes``, whose histograms are there."""
        s = self.settings
        for r in self.hist.where(F.col("fid") == -1).where(F.col("node").isin(nodes)).collect():  # a row for each node
            self.open[r.node] = _Level(np.array([r[c] for c in self.gs], float), np.array([r[c] for c in self.hs], float), r.n)
        able = [n for n in nodes if n in self.open and self.open[n].rows >= max(s.min_rows, 1) and (n + 1).bit_length() <= s.depth]
        if not able:
            return
        mine = self.hist.where((F.col("fid") >= 0) & F.col("node").isin(able))
        right = {f: frozenset(b for b in range(len(t)) if self.threshold(f, b) <= 0) for f, t in self.thresholds.items()}
        found: list[tuple] = []
        sets = sorted(self.categorical)
        if len(self.gs) == 1:
            spark = mine.sparkSession
            totals = spark.createDataFrame([(n, float(self.open[n].g[0]), float(self.open[n].h[0])) for n in able], "node int, g double, h double")
            numeric = mine.where(~F.col("fid").isin(*sets)) if sets else mine
            pairs = spark.createDataFrame([(f, b) for f, many in right.items() for b in many], "fid int, bin int")
            for r in best_splits(numeric.select("node", "fid", "bin", F.col("g0").alias("g"), F.col("h0").alias("h")), totals, s.reg_lambda, s.alpha, s.min_child, s.min_gain, pairs).collect():
                found.append((r.node, r.gain, r.fid, r.bin, None, r.hl))
            mine = mine.where(F.col("fid").isin(*sets)) if sets else None
        if mine is not None:
            sums = {n: (self.open[n].g, self.open[n].h) for n in able}
            rows = scanned_splits(mine, self.gs, self.hs, sums, self.categorical, right, s)
            best = rows.groupBy("node").agg(F.max(F.struct("gain", (-F.col("fid")).alias("f"), "bin", "left", "hl")).alias("t"))
            found += [(r.node, r.t.gain, -r.t.f, r.t.bin, r.t.left, r.t.hl) for r in best.collect()]  # a row for each node
        for node, *split in sorted(found, key=lambda x: (x[1], -x[2])):
            self.open[node].split = tuple(split)

    def threshold(self, fid: int, b: int) -> float:
        t = self.thresholds[fid]
        return t[b + 1] if b + 1 < len(t) else math.inf

    def close(self, node: int) -> None:
        level, s = self.open.pop(node), self.settings
        w = vector_weight(level.g, level.h, s.reg_lambda, s.alpha, s.max_weight)
        self.tree.leaves[node] = w if len(self.gs) > 1 else w[0]

    def grow(self) -> Tree:
        """Level by level, or with ``max_leaves`` always the open node of the greatest gain first."""
        self.hist = cut(self.histogram([0]), "hist")
        self.search([0])
        if not self.open:
            self.tree.leaves[0] = [0.0] * len(self.gs) if len(self.gs) > 1 else 0.0
            return self.tree
        while True:
            ready = [n for n, x in self.open.items() if x.split]
            if self.settings.max_leaves:
                room = self.settings.max_leaves - len(self.tree.leaves) - len(self.open)
                ready = sorted(ready, key=lambda n: (-self.open[n].split[0], n))[: min(1, max(room, 0))]
            if not ready:
                break
            small = []
            for n in ready:
                level = self.open.pop(n)
                gain, fid, b, left, hl = level.split
                self.tree.splits[n] = (fid, b, math.nan if left else self.threshold(fid, b), gain)
                if left:
                    self.tree.sets[n] = (tuple(self.thresholds[fid]), frozenset(left))
                small.append(2 * n + (1 if 2 * hl <= np.trace(_matrix(level.h, len(level.g))) else 2))
            part = self.histogram(small)
            columns = [*self.gs, *self.hs, "n"]
            sibling = F.when(F.col("node") % 2 == 1, F.col("node") + 1).otherwise(F.col("node") - 1)
            minus = part.select(sibling.alias("node"), "fid", "bin", *[(-F.col(c)).alias(c) for c in columns])
            pairs = F.create_map(*[F.lit(x) for n, c in zip(ready, small, strict=True) for x in (n, 4 * n + 3 - c)])
            rest = self.hist.where(F.col("node").isin(ready)).select(F.element_at(pairs, F.col("node")).alias("node"), "fid", "bin", *columns)
            # the sibling: the parent minus the smaller child
            other = rest.union(minus).groupBy("node", "fid", "bin").agg(*[F.sum(c).alias(c) for c in columns]).where("n > 0")
            kept = self.hist.where(F.col("node").isin(list(self.open)))
            last, self.hist = self.hist, cut(part.union(other).union(kept), "hist")
            drop_cut(last)
            self.search([c for n in ready for c in (2 * n + 1, 2 * n + 2)])
        for n in list(self.open):
            self.close(n)
        drop_cut(self.hist)
        return self.tree


def boost(entries: DataFrame, labels: DataFrame, objective: str = "logistic", rounds: int = 20, rate: float = 0.1, depth: int = 6, num_splits: int = 20, reg_lambda: float = 1.0, alpha: float = 0.0, min_child: float = 0.0, max_leaves: int = 0, max_weight: float = 0.0, row_share: float = 1.0, seed: int = 1, patience: int = 5, decay: float = 0.1, max_decays: int = 3, classes: int = 0, hessian: str = "diagonal", feature_share: float = 1.0, min_rows: int = 0, measure: str | None = None) -> BoostedModel:
    """Train on long entries (row_id, fid, value), one of a feature for each row, and (row_id, label).

    ``objective`` is logistic, squared, or multinomial over ``classes`` with a diagonal or full ``hessian``.
    ``max_leaves`` grows leaf-wise. Rows are sampled without, features with replacement. ``min_rows``: nodes of fewer aren't
    split. The rate falls by ``decay`` after ``patience`` rounds without progress of ``measure``; training stops after
    ``max_decays`` of these, and the trees after the best round are dropped. Rows without entries count with all values absent."""
    if hessian not in ("diagonal", "full") or objective == "multinomial" and classes < 2:
        raise ValueError("a multinomial objective needs classes, and a diagonal or full hessian")
    classes = classes if objective == "multinomial" else 0
    measure = measure or {"logistic": "log-loss", "squared": "rmse"}.get(objective, "cross-entropy")
    better = -1 if measure in ("precision", "auc") else 1
    table = cut(candidate_splits(entries, num_splits), "splits")
    thresholds = {r.fid: list(r.splits) for r in table.toLocalIterator()}
    zero_bin = lambda t: max(sum(p <= 0 for p in t) - 1, 0)
    categorical = {r.fid: zero_bin(thresholds[r.fid]) for r in table.where("categorical").toLocalIterator()}
    maps = binned(entries, table).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("fid", "bin"))).alias("bins"))
    start = F.array_repeat(F.lit(0.0), classes) if classes else F.lit(0.0)
    none = F.create_map().cast("map<int,int>")
    data = labels.select("row_id", F.col("label").cast("double").alias("label")).join(maps, "row_id", "left")
    data = cut(data.select("row_id", "label", F.coalesce("bins", none).alias("bins"), start.alias("score")), "rows")
    settings = Settings(depth, max(reg_lambda, 1.0), alpha, min_child, 0.0, max_leaves, max_weight, min_rows)
    model = BoostedModel([], rate, classes=classes)
    best, best_round, still, decays = math.inf, -1, 0, 0
    for k in range(rounds):
        if classes:
            g, h = multinomial_gradients(F.col("score"), F.col("label"), classes, hessian == "full")
        else:
            one = gradients(objective, F.col("score"), F.col("label"))
            g, h = [one[0]], [one[1]]
        sample = data.where(uniform(seed + k, "row_id") < row_share) if row_share < 1 else data
        sample = sample.select("bins", *[c.alias(f"g{i}") for i, c in enumerate(g)], *[c.alias(f"h{i}") for i, c in enumerate(h)])
        fids = None
        if feature_share < 1:
            drawn = np.random.Generator(np.random.PCG64([seed, k])).choice(sorted(thresholds), max(1, math.ceil(feature_share * len(thresholds))))
            fids = frozenset(int(f) for f in drawn)
        tree = _Grower(sample, thresholds, categorical, fids, settings, (len(g), len(h))).grow()
        # scaled at once, as the rate may fall later
        scale = rate / model.rate
        tree.leaves = {n: [x * scale for x in w] if classes else w * scale for n, w in tree.leaves.items()}
        model.trees.append(tree)
        add = tree.placed(F.col("bins"), lambda n, t=tree: F.lit(t.leaves[n]))
        score = F.zip_with("score", add, lambda a, b: a + b * model.rate) if classes else F.col("score") + add * model.rate
        last, data = data, cut(data.withColumn("score", score), "rows")
        drop_cut(last)
        loss = metric(data, measure, classes)
        model.history.append(loss)
        still = 0 if better * loss < best - 1e-4 else still + 1
        if better * loss < best:
            best, best_round = better * loss, k
        if still >= patience:
            rate, still, decays = rate * decay, 0, decays + 1
            if decays >= max_decays:
                break
    model.trees = model.trees[: best_round + 1]
    return model
