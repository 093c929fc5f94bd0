"""Model formulas: ``label ~ a + b:c - d``, ``.``, and 0 or 1 for the intercept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.scalar import StringIndexer, indicator
from orrery.operators.stage import Fitter, Stage
from orrery.operators.vector import _outer


def parse(text: str, columns: list[str]) -> tuple[str, list[tuple[str, ...]], bool]:
    """(label, terms, intercept): terms are tuples of columns, in order, without repetitions."""
    if text.count("~") != 1:
        raise ValueError("a formula has one ~")
    label, right = (x.strip() for x in text.split("~"))
    terms: list[tuple[str, ...]] = []
    intercept = True
    for sign, term in re.findall(r"([+-]?)\s*([^+\-\s][^+\-]*)", right):
        term = term.strip()
        if term in ("0", "1"):
            intercept = (term == "1") != (sign == "-")
            continue
        every = [(c,) for c in columns if c != label] if term == "." else [tuple(x.strip() for x in term.split(":"))]
        if any(not re.fullmatch(r"[\w.]+", c) for t in every for c in t):
            raise ValueError(f"can't read the term {term!r}")
        for t in every:
            same = [u for u in terms if sorted(u) == sorted(t)]
            if sign == "-":
                terms = [u for u in terms if u not in same]
            elif not same:
                terms.append(t)
    return label, terms, intercept


class RFormulaModel(Stage):
    """``labels`` has the category lists of string columns, most frequent first; the last category
    of a term is left out unless the formula has no intercept and the term comes first."""

    params = {"label": "label", "terms": [], "intercept": True, "labels": {}, "features_col": "features", "label_col": "label", "widths": {}}

    def apply(self, df: DataFrame) -> DataFrame:
        kinds, parts, free = dict(df.dtypes), [], not self.intercept

        def vector(c: str, drop: bool):
            if c in self.labels:
                index = F.lit(None).cast("int")
                for i, x in enumerate(self.labels[c]):
                    index = F.when(F.col(c) == x, i).otherwise(index)
                index = F.coalesce(index, F.raise_error(F.lit(f"unseen category in {c}")).cast("int"))
                return indicator(index, len(self.labels[c]) - drop)
            return F.transform(c, lambda x: x.cast("double")) if kinds[c].startswith("array") else F.array(F.col(c).cast("double"))

        for t in self.terms:
            if len(t) == 1:
                drop = t[0] in self.labels and not free
                free = free and t[0] not in self.labels
                parts.append(vector(t[0], drop))
            else:
                out = vector(t[0], False)
                for c in t[1:]:
                    out = _outer(out, vector(c, False))
                parts.append(out)
        df = df.withColumn(self.features_col, F.concat(*parts) if parts else F.array().cast("array<double>"))
        if self.label in df.columns and (self.label != self.label_col or self.label in self.labels):
            y = F.col(self.label).cast("double")
            if self.label in self.labels:
                y = F.lit(None).cast("double")
                for i, x in enumerate(self.labels[self.label]):
                    y = F.when(F.col(self.label) == x, float(i)).otherwise(y)
            df = df.withColumn(self.label_col, y)
        return df


class RFormula(Fitter):
    params = {"formula": "label ~ .", "features_col": "features", "label_col": "label", "order": "frequencyDesc", "force_index_label": False}

    def learn(self, df: DataFrame) -> RFormulaModel:
        label, terms, intercept = parse(self.formula, df.columns)
        kinds = dict(df.dtypes)
        used = {c for t in terms for c in t if kinds[c] == "string"}
        if label in kinds and (kinds[label] == "string" or self.force_index_label):
            used.add(label)
        labels = {c: StringIndexer(input=c, output="i", order=self.order).learn(df).labels for c in sorted(used)}
        return RFormulaModel(label=label, terms=[list(t) for t in terms], intercept=intercept, labels=labels, features_col=self.features_col, label_col=self.label_col)


