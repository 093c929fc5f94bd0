"""The stage contract: transformers and estimators that work in pyspark.ml pipelines.

Parameters are plain attributes, declared with their defaults in ``params``; stages and fitted
models are saved as JSON and loaded by class name.
"""

from __future__ import annotations

import copy
import importlib
import json

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame


class _Parameters:
    params: dict = {}

    def _declare(self, values: dict) -> None:
        known = {}
        for c in reversed(type(self).__mro__):
            known.update(vars(c).get("params", {}) if isinstance(vars(c).get("params"), dict) else {})
        unknown = set(values) - set(known)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameter {sorted(unknown)}")
        self._names = list(known)
        for k, v in {**known, **values}.items():
            setattr(self, k, v)

    def param_map(self) -> dict:
        return {k: getattr(self, k) for k in self._names}

    def copy(self, extra=None):
        other = copy.copy(self)
        for k, v in (extra or {}).items():
            setattr(other, getattr(k, "name", k), v)
        return other

    def save(self, path: str) -> None:
        """One JSON text file in a folder that Spark can write."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        body = json.dumps({"class": f"{type(self).__module__}.{type(self).__name__}", "params": self.param_map()})
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_stage(path: str):
    """The stage or model that ``save`` wrote."""
    from pyspark.sql import SparkSession

    body = json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first().value)
    module, name = body["class"].rsplit(".", 1)
    return getattr(importlib.import_module(module), name)(**body["params"])


class Stage(_Parameters, Transformer):
    """A transformer; subclasses define ``params`` and ``apply``."""

    def __init__(self, **values) -> None:
        Transformer.__init__(self)
        self._declare(values)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Fitter(_Parameters, Estimator):
    """An estimator; subclasses define ``params`` and ``learn``, which returns a Stage."""

    def __init__(self, **values) -> None:
        Estimator.__init__(self)
        self._declare(values)

    def _fit(self, df: DataFrame) -> Stage:
        return self.learn(df)

    def learn(self, df: DataFrame) -> Stage:
        raise NotImplementedError


def checked_policy(value: str, allowed=("error", "skip", "keep")) -> str:
    if value not in allowed:
        raise ValueError(f"handle_invalid is one of {allowed}, not {value!r}")
    return value
