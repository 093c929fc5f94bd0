"""Exchange with stock ML columns, attribute names and line parsers, on awkward rows."""

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix, SparseMatrix, Vectors
from pyspark.sql import functions as F

from orrery.operators import interop, statistics
from orrery.plans.storage import cut
from orrery.sources import examples


def test_vectors_there_and_back(spark):
    stock = spark.createDataFrame([(1, Vectors.dense([0.0, 2.0, 0.0])), (2, Vectors.sparse(5, [1, 4], [3.0, -1.0])), (3, None), (4, Vectors.sparse(0, [], []))], ["id", "v"])
    ours = interop.from_ml(stock, "v")
    got = {r.id: r.v for r in ours.collect()}
    assert (got[1].size, got[1].indices, got[1].values) == (3, [1], [2.0])
    assert (got[2].size, got[2].indices, got[2].values) == (5, [1, 4], [3.0, -1.0])
    assert got[3] is None and got[4].indices == []
    back = {r.id: r.v for r in interop.to_ml(ours, "v").collect()}
    assert back[2] == Vectors.sparse(5, [1, 4], [3.0, -1.0]) and back[3] is None
    assert list(back[1].toArray()) == [0.0, 2.0, 0.0]
    dense = {r.id: r.v for r in interop.from_ml(stock, "v", dense=True).collect()}
    assert dense[2] == [0.0, 3.0, 0.0, 0.0, -1.0] and dense[3] is None
    assert interop.to_ml(spark.createDataFrame([(1, [1.0, 2.0])], "id int, x array<double>")).first().x == Vectors.dense([1.0, 2.0])


def test_matrices_in_all_layouts(spark):
    rows = [[1.0, 0.0, 2.0], [0.0, 3.0, 0.0]]
    column_major = [1.0, 0.0, 0.0, 3.0, 2.0, 0.0]
    stock = [
        (1, DenseMatrix(2, 3, column_major)),
        (2, DenseMatrix(2, 3, [1.0, 0.0, 2.0, 0.0, 3.0, 0.0], True)),
        (3, SparseMatrix(2, 3, [0, 1, 2, 3], [0, 1, 0], [1.0, 3.0, 2.0])),
        (4, SparseMatrix(2, 3, [0, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0], True)),
    ]
    df = spark.createDataFrame(stock, ["id", "m"])
    assert all(r.m == rows for r in interop.matrix_from_ml(df, "m").collect())
    again = interop.matrix_to_ml(cut(interop.matrix_from_ml(df, "m")), "m")
    assert all((r.m.toArray() == stock[0][1].toArray()).all() for r in again.collect())


def test_attributes_are_renamed_in_order(spark):
    df = VectorAssembler(inputCols=["a_b", "c"], outputCol="f").transform(spark.createDataFrame([(1.0, 2.0, 3)], "a_b double, c double, z int"))
    out = interop.AttributeRewriter(input="f", prefixes={"a_": "x_", "x_b": "y"}).transform(df)
    assert interop.attribute_names(out, "f") == ["y", "c"] and out.columns == ["a_b", "c", "z", "f"]
    plain = df.select("z", F.array("c").alias("f"))
    assert interop.AttributeRewriter(input="f", prefixes={"a": "b"}).transform(plain).columns == ["z", "f"]


def test_lines_of_online_learners(spark):
    df = spark.createDataFrame([(1, "1 7:0.5  3:2"), (2, None), (3, "-1"), (4, "0 3:1")], "id int, line string")
    got = {r.id: r for r in df.select("id", examples.parse_example(F.col("line"), 9).alias("p"), examples.parse_label(F.col("line"), True).alias("n"), examples.parse_label(F.col("line"), False).alias("z"), examples.parse_label(F.col("line")).alias("t")).collect()}
    assert got[1].p.label == 1.0 and got[1].p.features.indices == [7, 3] and got[1].p.features.values == [0.5, 2.0] and got[2].p is None
    assert got[3].p.features.indices == [] and (got[3].n, got[3].z, got[4].n, got[4].z, got[4].t) == (-1.0, 0.0, -1.0, 0.0, "0")
    p = examples.parse_example(F.lit("5 6 0"), 9, "int", "dummy", labelled=False)
    r = df.select(p.alias("p"), examples.append_bias(p["features"]).alias("b")).first()
    assert math.isnan(r.p.label) and r.p.attached == "" and r.p.features.values == [1.0] * 3
    assert r.b.indices == [0, 5, 6] and r.b["values"] == [1.0, 1.0, 1.0]


def test_model_size_of_an_empty_table(spark):
    df = spark.createDataFrame([], "features struct<size: long, indices: array<long>, values: array<double>>")
    assert tuple(statistics.active_features(df).first()) == (0, 0)
