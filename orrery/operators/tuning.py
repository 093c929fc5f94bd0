"""Splits, parameter grids, validation and the auto-tuner."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the seed and the row's keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def folds_by(df: DataFrame, number: Column, k: int) -> DataFrame:
    """Folds 0..k-1 by a whole number, with nothing random about them."""
    return df.withColumn("fold", F.pmod(number, F.lit(k)))


def hash_folds(df: DataFrame, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)))


def split(df: DataFrame, keys: list[str], shares: list[float], seed: int = 42) -> list[DataFrame]:
    """Disjoint parts of the given shares, by a hash of the keys: reruns agree."""
    u, edge, out = uniform(seed, *keys), 0.0, []
    for k, s in enumerate(shares):
        top = edge + s / sum(shares) if k < len(shares) - 1 else 2.0
        out.append(df.where((u >= edge) & (u < top)))
        edge = top
    return out


def weighted_sample(df: DataFrame, weight: Column, fraction: float, seed: int, keys) -> DataFrame:
    """Rows with u <= fraction * weight for a u of each row."""
    return df.where(uniform(seed, *keys) <= F.lit(fraction) * weight)


def param_grid(grid: dict[str, list]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())]


def _scores(df_pairs, estimator, grid, evaluator, parallelism: int) -> np.ndarray:
    def one(job):
        (train, test), params = job
        model = estimator.copy(params).fit(train)
        return evaluator.evaluate(model.transform(test))

    jobs = [(pair, params) for pair in df_pairs for params in grid]
    with ThreadPoolExecutor(parallelism) as pool:
        return np.array(list(pool.map(one, jobs))).reshape(len(df_pairs), len(grid))


class CrossValidator:
    """k folds by a hash of ``keys``; the best parameters are fitted again on all rows."""

    def __init__(self, estimator, grid: list[dict], evaluator, keys: list[str], k: int = 3, seed: int = 42, parallelism: int = 2, larger_is_better: bool = True):
        self.estimator, self.grid, self.evaluator, self.keys = estimator, grid, evaluator, keys
        self.k, self.seed, self.parallelism, self.larger = k, seed, parallelism, larger_is_better

    def pairs(self, df: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        f = hash_folds(df, self.keys, self.k, self.seed)
        return [(f.where(F.col("fold") != i).drop("fold"), f.where(F.col("fold") == i).drop("fold")) for i in range(self.k)]

    def fit(self, df: DataFrame):
        """(model, parameters, mean score of each of the grid)."""
        mean = _scores(self.pairs(df), self.estimator, self.grid, self.evaluator, self.parallelism).mean(0)
        best = self.grid[int(mean.argmax() if self.larger else mean.argmin())]
        return self.estimator.copy(best).fit(df), best, mean.tolist()


class TrainValidationSplit(CrossValidator):
    def __init__(self, *args, train_share: float = 0.75, **kwargs):
        super().__init__(*args, **kwargs)
        self.train_share = train_share

    def pairs(self, df: DataFrame):
        return [tuple(split(df, self.keys, [self.train_share, 1 - self.train_share], self.seed))]


class AutoTuner:
    """Suggest, try, learn. Strategies: grid, random, and a Gaussian process with expected
    improvement. A space maps names to (low, high) or to a list of choices."""

    def __init__(self, space: dict, strategy: str = "gaussian", seed: int = 42, minimize: bool = False):
        self.space, self.strategy, self.minimize = space, strategy, minimize
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.tried: list[dict] = []
        self.scores: list[float] = []

    def _random(self) -> dict:
        return {k: (v[int(self.rng.integers(len(v)))] if isinstance(v, list) else float(self.rng.uniform(*v))) for k, v in self.space.items()}

    def _unit(self, p: dict) -> np.ndarray:
        return np.array([v.index(p[k]) / max(len(v) - 1, 1) if isinstance(v, list) else (p[k] - v[0]) / ((v[1] - v[0]) or 1) for k, v in self.space.items()])

    def suggest(self) -> dict:
        if self.strategy == "grid":
            axes = [v if isinstance(v, list) else list(np.linspace(*v, 5)) for v in self.space.values()]
            every = [dict(zip(self.space, x, strict=True)) for x in itertools.product(*axes)]
            return every[len(self.tried) % len(every)]
        if self.strategy == "random" or len(self.tried) < 3:
            return self._random()
        x = np.array([self._unit(p) for p in self.tried])
        y = np.array(self.scores) * (-1 if self.minimize else 1)
        scale = y.std() or 1.0
        z = (y - y.mean()) / scale
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * 0.2**2))
        k = kernel(x, x) + 1e-4 * np.eye(len(x))
        some = [self._random() for _ in range(256)]
        c = kernel(np.array([self._unit(p) for p in some]), x)
        mean = c @ np.linalg.solve(k, z)
        std = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", c, np.linalg.solve(k, c.T)), 1e-12))
        u = (mean - z.max()) / std
        cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in u])
        gain = std * (u * cdf + np.exp(-u * u / 2) / math.sqrt(2 * math.pi))
        return some[int(gain.argmax())]

    def observe(self, params: dict, score: float) -> None:
        self.tried.append(params)
        self.scores.append(score)

    def run(self, trial: Callable[[dict], float], rounds: int) -> tuple[dict, float]:
        for _ in range(rounds):
            p = self.suggest()
            self.observe(p, trial(p))
        best = int(np.argmin(self.scores) if self.minimize else np.argmax(self.scores))
        return self.tried[best], self.scores[best]
