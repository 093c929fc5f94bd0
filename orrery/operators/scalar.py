"""Transformers of scalar columns: thresholds, buckets, imputation, category indexes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.stage import Fitter, Stage, checked_policy


class Binarizer(Stage):
    """1.0 where a number, or each component of an array, exceeds the threshold, else 0.0."""

    params = {"input": "value", "output": "binarized", "threshold": 0.0}

    def apply(self, df: DataFrame) -> DataFrame:
        over = lambda x: F.when(x > self.threshold, 1.0).otherwise(0.0)
        is_array = dict(df.dtypes)[self.input].startswith("array")
        return df.withColumn(self.output, F.transform(self.input, over) if is_array else over(F.col(self.input)))


def bucket(x: Column, splits: list[float], policy: str) -> Column:
    """Index of the bucket [a, b) of x, the last one closed; NaN and null get an extra bucket under
    ``keep``, null under ``skip``, and raise under ``error``; numbers outside always raise."""
    if len(splits) < 3 or any(not a < b for a, b in zip(splits, splits[1:], strict=False)):
        raise ValueError("at least three strictly increasing splits")
    n = len(splits) - 1
    inner = reduce(lambda a, b: a + b, [F.when(x >= s, 1.0).otherwise(0.0) for s in splits[1:-1]])
    missing = x.isNull() | F.isnan(x)
    outside = (x < splits[0]) | (x > splits[-1])
    instead = {"keep": F.lit(float(n)), "skip": F.lit(None).cast("double"), "error": F.raise_error(F.lit("missing value in a bucketed column")).cast("double")}
    wrong = F.raise_error(F.concat(F.lit("value outside the splits: "), x.cast("string"))).cast("double")
    return F.when(missing, instead[checked_policy(policy)]).when(outside, wrong).otherwise(inner)


class Bucketizer(Stage):
    """Buckets of one or more columns; ``splits`` has a list of split points for each."""

    params = {"inputs": ["value"], "outputs": ["bucket"], "splits": [], "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        if self.handle_invalid == "skip":
            for c in self.inputs:
                df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
        return df.withColumns({o: bucket(F.col(i).cast("double"), list(s), self.handle_invalid) for i, o, s in zip(self.inputs, self.outputs, self.splits, strict=True)})


class QuantileDiscretizer(Fitter):
    """Buckets at the i/n quantiles (within ``relative_error`` of the rank), ends open, equal split
    points merged."""

    params = {"inputs": ["value"], "outputs": ["bucket"], "num_buckets": 2, "relative_error": 0.001, "handle_invalid": "error"}

    def learn(self, df: DataFrame) -> Bucketizer:
        counts = self.num_buckets if isinstance(self.num_buckets, list) else [self.num_buckets] * len(self.inputs)
        splits = []
        for c, n in zip(self.inputs, counts, strict=True):
            points = df.where(~F.isnan(F.col(c).cast("double"))).select(F.col(c).cast("double").alias("x"))
            got = points.approxQuantile("x", [k / n for k in range(1, n)], self.relative_error)
            splits.append([-math.inf, *sorted(set(got)), math.inf])
        return Bucketizer(inputs=self.inputs, outputs=self.outputs, splits=splits, handle_invalid=self.handle_invalid)


class ImputerModel(Stage):
    params = {"inputs": ["value"], "outputs": ["imputed"], "surrogates": [], "missing_value": math.nan}

    def apply(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, o, s in zip(self.inputs, self.outputs, self.surrogates, strict=True):
            x = F.col(i).cast("double")
            gone = F.isnan(x) if math.isnan(self.missing_value) else x == self.missing_value
            out[o] = F.when(x.isNull() | gone, F.lit(float(s))).otherwise(x)
        return df.withColumns(out)


class Imputer(Fitter):
    """Missing numbers (null or ``missing_value``) become the mean or median of the others."""

    params = {"inputs": ["value"], "outputs": ["imputed"], "strategy": "mean", "missing_value": math.nan, "relative_error": 0.001}

    def learn(self, df: DataFrame) -> ImputerModel:
        kept = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.col(c) != self.missing_value if not math.isnan(self.missing_value) else F.lit(True)), F.col(c).cast("double")) for c in self.inputs}
        if self.strategy == "mean":
            row = df.agg(*[F.avg(x).alias(c) for c, x in kept.items()]).first()
        elif self.strategy == "median":
            row = df.agg(*[F.percentile_approx(x, 0.5, round(1 / self.relative_error)).alias(c) for c, x in kept.items()]).first()
        else:
            raise ValueError("strategy is mean or median")
        if any(v is None for v in row):
            raise ValueError("a column has no value to impute from")
        return ImputerModel(inputs=self.inputs, outputs=self.outputs, surrogates=list(row), missing_value=self.missing_value)


class StringIndexerModel(Stage):
    params = {"input": "value", "output": "index", "labels": [], "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        if self.input not in df.columns:
            return df
        checked_policy(self.handle_invalid)
        key = F.col(self.input).cast("string")
        if len(self.labels) <= 32:
            index = F.lit(None).cast("double")
            for i, x in enumerate(self.labels):
                index = F.when(key == x, float(i)).otherwise(index)
        else:
            # the model's labels, as a table
            rows = [(x, float(i)) for i, x in enumerate(self.labels)]
            table = F.broadcast(df.sparkSession.createDataFrame(rows, "__label string, __index double"))
            df = df.join(table, key == F.col("__label"), "left").drop("__label")
            index = F.col("__index")
        meta = {"ml_attr": {"type": "nominal", "vals": [*self.labels, *["__unknown"] * (self.handle_invalid == "keep")], "name": self.output}}
        if self.handle_invalid == "skip":
            df = df.where(index.isNotNull())
        elif self.handle_invalid == "keep":
            index = F.coalesce(index, F.lit(float(len(self.labels))))
        else:
            index = F.coalesce(index, F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(key, F.lit("null")))).cast("double"))
        return df.withColumn(self.output, index.alias(self.output, metadata=meta)).drop("__index")


def label_index(df: DataFrame, column: str, order: str = "frequencyDesc") -> DataFrame:
    """(label, n, index) of a column's values: by frequency or by the alphabet, ties by the alphabet."""
    from pyspark.sql.window import Window

    by = {
        "frequencyDesc": [F.desc("n"), F.asc("label")],
        "frequencyAsc": [F.asc("n"), F.asc("label")],
        "alphabetDesc": [F.desc("label")],
        "alphabetAsc": [F.asc("label")],
    }[order]
    counts = df.select(F.col(column).cast("string").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("index", F.row_number().over(Window.orderBy(*by)) - 1)


class StringIndexer(Fitter):
    params = {"input": "value", "output": "index", "order": "frequencyDesc", "handle_invalid": "error"}

    def learn(self, df: DataFrame) -> StringIndexerModel:
        labels = [r.label for r in label_index(df, self.input, self.order).orderBy("index").toLocalIterator()]
        return StringIndexerModel(input=self.input, output=self.output, labels=labels, handle_invalid=self.handle_invalid)


class IndexToString(Stage):
    """The inverse: labels from the parameter, or from the column's metadata."""

    params = {"input": "index", "output": "label", "labels": []}

    def apply(self, df: DataFrame) -> DataFrame:
        labels = self.labels or df.schema[self.input].metadata["ml_attr"]["vals"]
        return df.withColumn(self.output, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(self.input).cast("int") + 1))


def indicator(x: Column, width: int) -> Column:
    """The vector of ``width`` components that is 1 at x and 0 elsewhere."""
    if width <= 0:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == x, 1.0).otherwise(0.0))


class OneHotModel(Stage):
    params = {"inputs": ["index"], "outputs": ["onehot"], "sizes": [], "drop_last": True, "handle_invalid": "error"}

    def apply(self, df: DataFrame) -> DataFrame:
        keep = checked_policy(self.handle_invalid, ("error", "keep")) == "keep"
        out = {}
        for i, o, n in zip(self.inputs, self.outputs, self.sizes, strict=True):
            width = n + keep - self.drop_last
            x = F.col(i).cast("int")
            bad = x.isNull() | (x < 0) | (x >= n)
            x = F.when(bad, F.lit(n) if keep else F.raise_error(F.lit("category out of range")).cast("int")).otherwise(x)
            out[o] = indicator(x, width)
        return df.withColumns(out)


class OneHotEncoder(Fitter):
    """Category indexes as indicator vectors; sizes from metadata if there, else the maximum + 1."""

    params = {"inputs": ["index"], "outputs": ["onehot"], "drop_last": True, "handle_invalid": "error"}

    def learn(self, df: DataFrame) -> OneHotModel:
        known = {c: len(df.schema[c].metadata.get("ml_attr", {}).get("vals", [])) for c in self.inputs}
        rest = [c for c in self.inputs if not known[c]]
        if rest:
            known |= df.agg(*[(F.max(c).cast("int") + 1).alias(c) for c in rest]).first().asDict()
        return OneHotModel(inputs=self.inputs, outputs=self.outputs, sizes=[int(known[c]) for c in self.inputs], drop_last=self.drop_last, handle_invalid=self.handle_invalid)


#: The multi-hot encoder of several columns does the same.
MultiHotEncoder = OneHotEncoder


class ArrayMultiHot(Stage):
    """Indicator vector of an array of category indexes; indexes out of range are ignored."""

    params = {"input": "indexes", "output": "multihot", "size": 2}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda k: F.when(F.array_contains(F.transform(self.input, lambda x: x.cast("int")), k), 1.0).otherwise(0.0)))


class SqlTransformer(Stage):
    """Any Spark SQL over ``__THIS__``."""

    params = {"statement": "SELECT * FROM __THIS__"}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(self.statement.replace("__THIS__", "{__this}"), __this=df)


class ColumnPruner(Stage):
    params = {"drop": []}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.drop)
