"""Exchange with Spark's own ML columns: vectors, matrices and the attribute names beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import vectors as V
from orrery.operators.stage import Stage


def _is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"size", "indices", "values"} <= set(kind.names)


def to_ml(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (dense arrays, or sparse structs whose sizes fit 32 bits) as stock ML vectors; all vector
    columns without names. Arrays stay in the JVM; a sparse vector takes Python, as only there it can be made
    without being filled up. Null vectors stay null."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import SparseVector, VectorUDT

    sparse = F.udf(lambda n, i, x: None if n is None else SparseVector(int(n), i, x), VectorUDT())
    kinds = {f.name: f.dataType for f in df.schema}
    is_array = lambda k: isinstance(k, T.ArrayType) and isinstance(k.elementType, T.NumericType)
    columns = columns or tuple(c for c, k in kinds.items() if _is_sparse(k) or is_array(k))
    made = {}
    for c in columns:
        if _is_sparse(kinds[c]):
            made[c] = sparse(F.col(c)["size"], F.col(c)["indices"].cast("array<int>"), F.col(c)["values"])
        else:
            made[c] = F.when(F.col(c).isNotNull(), array_to_vector(F.col(c).cast("array<double>")))
    return df.withColumns(made)


def from_ml(df: DataFrame, *columns: str, dense: bool = False) -> DataFrame:
    """Stock ML vectors as sparse structs (``functions.vectors.SPARSE``), or arrays if ``dense``; all such columns
    without names. Zeros of dense vectors are left out of the structs. Null vectors stay null."""
    columns = columns or tuple(f.name for f in df.schema if f.dataType.typeName() == "vectorudt")
    made = {}
    for c in columns:
        raw = F.unwrap_udt(c)  # (type 0: sparse, size, indices, values)
        pairs = F.transform(raw["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        given = F.filter(pairs, lambda p: p.x != 0)
        stored = F.struct(raw["size"].cast("long").alias("size"), raw["indices"].cast("array<bigint>").alias("indices"), raw["values"].alias("values"))
        filled = F.struct(F.size(raw["values"]).cast("long").alias("size"), F.transform(given, lambda p: p.i.cast("long")).alias("indices"), F.transform(given, lambda p: p.x).alias("values"))
        v = F.when(raw["type"] == 0, stored).otherwise(filled)
        made[c] = F.when(F.col(c).isNotNull(), V.to_dense(v) if dense else v)
    return df.withColumns(made)


def matrix_to_ml(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of rows (equally long arrays) as stock dense matrices, made in Python. Spark can't evaluate a Python
    function over nested lambdas of the same plan, so write what ``matrix_from_ml`` gives before converting it again."""
    from pyspark.ml.linalg import DenseMatrix, MatrixUDT

    def made(rows):
        if rows is None:
            return None
        width = len(rows[0]) if rows else 0
        return DenseMatrix(len(rows), width, [float(r[j]) for j in range(width) for r in rows])

    convert = F.udf(made, MatrixUDT())
    return df.withColumns({c: convert(c) for c in columns})


def _matrix_rows(m: Column) -> Column:
    """The rows of an unwrapped matrix (type 0: sparse, numRows, numCols, colPtrs, rowIndices, values,
    isTransposed); its lines are rows if transposed, else columns."""
    length = F.when(m["isTransposed"], m["numCols"]).otherwise(m["numRows"])

    def stored(k: Column) -> Column:
        start = F.get(m["colPtrs"], k)
        return F.slice(F.arrays_zip(m["rowIndices"].alias("i"), m["values"].alias("x")), start + 1, F.get(m["colPtrs"], k + 1) - start)

    def entry(k: Column, j: Column) -> Column:
        found = F.get(F.filter(stored(k), lambda e: e.i == j), 0)["x"]
        return F.when(m["type"] == 0, F.coalesce(found, F.lit(0.0))).otherwise(F.get(m["values"], k * length + j))

    counted = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    return F.transform(counted(m["numRows"]), lambda i: F.transform(counted(m["numCols"]), lambda j: F.when(m["isTransposed"], entry(i, j)).otherwise(entry(j, i))))


def matrix_from_ml(df: DataFrame, *columns: str) -> DataFrame:
    """Stock matrices (dense or sparse, by columns or by rows) as arrays of rows."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), _matrix_rows(F.unwrap_udt(c))) for c in columns})


class AttributeRewriter(Stage):
    """Renames the attributes of a vector column: each old text of ``prefixes`` becomes the new one, in their
    order; the column moves to the end. Attributes without names, and columns without attributes, stay."""

    params = {"input": "features", "prefixes": {}}

    def apply(self, df: DataFrame) -> DataFrame:
        metadata = dict(df.schema[self.input].metadata)

        def renamed(attribute: dict) -> dict:
            if "name" not in attribute:
                return attribute
            name = attribute["name"]
            for old, new in self.prefixes.items():
                name = name.replace(old, new)
            return {**attribute, "name": name}

        if "attrs" in metadata.get("ml_attr", {}):
            group = dict(metadata["ml_attr"])
            group["attrs"] = {kind: [renamed(a) for a in many] for kind, many in group["attrs"].items()}
            metadata["ml_attr"] = group
        rest = [c for c in df.columns if c != self.input]
        return df.select(*rest, F.col(self.input).alias(self.input, metadata=metadata))


def attribute_names(df: DataFrame, column: str) -> list[str]:
    """The names of a vector column's attributes, in the order of their indexes."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    return [a.get("name", "") for a in sorted((a for many in attrs.values() for a in many), key=lambda a: a["idx"])]


def named_attributes(column: Column, name: str, names: list[str]) -> Column:
    """A vector column with numeric attributes of these names."""
    attrs = {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}
    return column.alias(name, metadata={"ml_attr": {"attrs": attrs, "num_attrs": len(names)}})
