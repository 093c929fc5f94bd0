"""Known values of single stages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import distributions as D
from orrery.functions import vectors as V
from orrery.operators import scalar as S
from orrery.operators import text as T
from orrery.operators import vector as O
from orrery.operators.formula import parse
from orrery.operators.stage import load_stage


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id int, v array<double>")


def column(df, name, order="id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def close(a, b, tol=1e-5):
    return all(len(x) == len(y) and all((math.isnan(p) and math.isnan(q)) or abs(p - q) < tol for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_bucketizer(spark):
    df = spark.createDataFrame([(0, -0.5), (1, -0.3), (2, 0.0), (3, 0.2), (4, 0.5)], "id int, x double")
    b = S.Bucketizer(inputs=["x"], outputs=["b"], splits=[[-0.5, 0.0, 0.5]])
    assert column(b.transform(df), "b") == [0, 0, 1, 1, 1]
    with pytest.raises(Exception, match="outside"):
        b.transform(df.withColumn("x", F.lit(0.51))).collect()
    gone = spark.createDataFrame([(0, float("nan")), (1, None)], "id int, x double")
    keep = S.Bucketizer(inputs=["x"], outputs=["b"], splits=[[-0.5, 0.0, 0.5]], handle_invalid="keep")
    assert column(keep.transform(gone), "b") == [2, 2]
    with pytest.raises(ValueError):
        S.bucket(F.lit(1.0), [0.0, 1.0], "error")


def test_quantile_discretizer_keeps_missing(spark):
    values = [-0.9, -0.5, -0.3, 0.0, 0.2, 0.5, 0.9, math.nan, math.nan, math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value double")
    q = S.QuantileDiscretizer(num_buckets=3, handle_invalid="keep", relative_error=0.0).fit(df)
    assert column(q.transform(df), "bucket") == [0, 0, 1, 1, 2, 2, 2, 3, 3, 3]


def test_imputer(spark):
    df = spark.createDataFrame([(0, 1.0, 4.0), (1, 11.0, 12.0), (2, 3.0, math.nan), (3, math.nan, 14.0)], "id int, a double, b double")
    mean = S.Imputer(inputs=["a", "b"], outputs=["x", "y"]).fit(df)
    assert mean.surrogates == [5.0, 10.0]
    assert S.Imputer(inputs=["a", "b"], outputs=["x", "y"], strategy="median").fit(df).surrogates == [3.0, 12.0]


@pytest.mark.parametrize("order, labels", [("frequencyDesc", ["b", "a", "c"]), ("frequencyAsc", ["c", "a", "b"]), ("alphabetDesc", ["c", "b", "a"]), ("alphabetAsc", ["a", "b", "c"])])
def test_string_indexer_orders(spark, order, labels):
    df = spark.createDataFrame([(x,) for x in "bbcaab" + "b"], "value string")
    assert S.StringIndexer(order=order).fit(df).labels == labels


def test_string_indexer_policies_and_inverse(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("abcaac")], "id int, value string")
    m = S.StringIndexer().fit(df)
    assert column(m.transform(df), "index") == [0, 2, 1, 0, 0, 1]
    assert column(S.IndexToString(output="back").transform(m.transform(df)), "back") == list("abcaac")
    other = spark.createDataFrame([(0, "a"), (1, "z"), (2, None)], "id int, value string")
    with pytest.raises(Exception, match="unseen"):
        m.transform(other).collect()
    assert column(m.copy({"handle_invalid": "skip"}).transform(other), "index") == [0]
    assert column(m.copy({"handle_invalid": "keep"}).transform(other), "index") == [0, 3, 3]


def test_one_hot(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2, 0, 0, 2])], "id int, index double")
    m = S.OneHotEncoder(drop_last=False).fit(df)
    assert column(m.transform(df), "onehot")[:3] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    keep = S.OneHotEncoder(drop_last=False, handle_invalid="keep").fit(df)
    assert column(keep.transform(df.where("id = 0").withColumn("index", F.lit(3.0))), "onehot") == [[0, 0, 0, 1]]


def test_assembler_and_sparse_forms(spark):
    df = spark.sql("select 0 id, 0.0D x, array(1D, 2D) y, named_struct('size', 2L, 'indices', array(1L), 'values', array(3D)) z, 10 n")
    out = O.VectorAssembler(inputs=["x", "y", "z", "n"], output="f").transform(df)
    assert column(out, "f") == [[0, 1, 2, 0, 3, 10]]
    s = out.select(V.to_sparse(F.col("f")).alias("s"), V.compressed_is_sparse(F.col("f")).alias("c")).first()
    assert (s.s.indices, s.s["values"], s.c) == ([1, 2, 4, 5], [1, 2, 3, 10], False)
    big = spark.sql("select '(5000000000,[4999999999],[1.5])' t").select(V.parse(F.col("t")).alias("v")).first().v
    assert (big.size, big.indices, big["values"]) == (5_000_000_000, [4_999_999_999], [1.5])


def test_scalers(spark):
    df = vectors(spark, [(-2, 2.3, 0), (0, -5.1, 1), (1.7, -0.6, 3.3)])
    std = O.StandardScaler(input="v", output="o").fit(df).transform(df)
    x = np.array([(-2, 2.3, 0), (0, -5.1, 1), (1.7, -0.6, 3.3)])
    assert close(column(std, "o"), (x / x.std(0, ddof=1)).tolist())
    both = O.StandardScaler(input="v", output="o", with_mean=True).fit(df).transform(df)
    assert close(column(both, "o"), ((x - x.mean(0)) / x.std(0, ddof=1)).tolist())
    m = vectors(spark, [(1, 0, -9.223372036854775808e18), (2, 0, 0), (3, 0, 9.223372036854775807e18), (1.5, 0, 0)])
    got = O.MinMaxScaler(input="v", output="o", low=-5.0, high=5.0).fit(m).transform(m)
    assert close(column(got, "o"), [(-5, 0, -5), (0, 0, 0), (5, 0, 5), (-2.5, 0, 0)])
    a = vectors(spark, [(1, 0, 100), (2, 0, 0), (-2, 0, -100), (-1.5, 0, 0)])
    assert close(column(O.MaxAbsScaler(input="v", output="o").fit(a).transform(a), "o"), [(0.5, 0, 1), (1, 0, 0), (-1, 0, -1), (-0.75, 0, 0)])
    nan = vectors(spark, [(1, math.nan), (3, 2.0), (2, 4.0)])
    assert close(column(O.MinMaxScaler(input="v", output="o").fit(nan).transform(nan), "o"), [(0, math.nan), (1, 0), (0.5, 1)])


def test_normalizer_polynomials_interaction_dct(spark):
    df = vectors(spark, [(-2, 2.3), (0, 0)])
    n1 = O.Normalizer(input="v", output="o", p=1.0).transform(df)
    assert close(column(n1, "o"), [(-0.465116, 0.534884), (0, 0)])
    assert close(column(O.PolynomialExpansion(input="v", output="o", size=2).transform(df), "o"), [(-2, 4, 2.3, -4.6, 5.29), (0,) * 5])
    assert len(O.PolynomialExpansion(size=3, degree=3).terms()) == O.monomials(3, 3)
    i = spark.createDataFrame([(0, 2.0, [3.0, 4.0])], "id int, a double, b array<double>")
    assert column(O.Interaction(inputs=["a", "b"], output="o").transform(i), "o") == [[6, 8]]
    assert column(O.Interaction(inputs=["a", "b"], output="o", levels={"a": 3}).transform(i), "o") == [[0, 0, 0, 0, 3, 4]]
    back = O.DCT(input="o", output="p", size=2, inverse=True).transform(O.DCT(input="v", output="o", size=2).transform(df))
    assert close(column(back, "p"), [(-2, 2.3), (0, 0)])


def test_text_stages(spark):
    df = spark.createDataFrame([(0, "Te,st. punct"), (1, "A  b \n "), (2, "")], "id int, text string")
    assert column(T.Tokenizer().transform(df), "tokens") == [["te,st.", "punct"], ["a", "", "b"], []]
    found = T.RegexTokenizer(pattern=r"\w+|\p{Punct}", gaps=False).transform(df)
    assert column(found, "tokens")[0] == ["te", ",", "st", ".", "punct"]
    assert column(T.RegexTokenizer(pattern=r"\w+|\p{Punct}", gaps=False, min_length=3).transform(df), "tokens")[0] == ["punct"]
    t = spark.createDataFrame([(0, ["Test", "for", "ngram", "."]), (1, ["x"])], "id int, tokens array<string>")
    assert column(T.NGram().transform(t), "ngrams") == [["Test for", "for ngram", "ngram ."], []]
    s = spark.createDataFrame([(0, ["A", "The", "AN"]), (1, [None]), (2, [])], "id int, tokens array<string>")
    assert column(T.StopWordsRemover().transform(s), "filtered") == [[], [None], []]


def test_hashing_follows_sql_hash(spark):
    df = spark.createDataFrame([(0, ["abc", "abcd", "abc"])], "id int, tokens array<string>")
    v = column(T.HashingTF().transform(df), "tf")[0]
    assert dict(zip(v.indices, v["values"], strict=True)) == {183220: 2.0, 58828: 1.0}


def test_minhash_and_projection(spark):
    from orrery.operators import lsh

    row = spark.sql("select array(2, 3, 5, 7) i, array(1.23D, 4.56D) v").select(lsh.minhash(F.col("i"), [(0, 1), (1, 2), (3, 0)]), lsh.projection(F.col("v"), [[0.0, 1.0], [1.0, 0.0]], 0.5)).first()
    assert list(row[0]) == [1, 5, 9] and list(row[1]) == [9, 2]


def test_chi_square_by_feature(spark):
    rows = [(0.0, [8, 7, 0]), (1.0, [0, 9, 6]), (1.0, [0, 9, 8]), (2.0, [8, 9, 5])]
    from orrery.operators.statistics import chi_square_by_feature

    df = spark.createDataFrame([(y, [float(x) for x in v]) for y, v in rows], "label double, v array<double>")
    got = {r.idx: (round(r.statistic, 6), r.df) for r in chi_square_by_feature(df, "v", "label").collect()}
    assert got == {0: (4.0, 2), 1: (4.0, 2), 2: (8.0, 6)}
    assert abs(D.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(D.t_two_sided(2.228138851964939, 10) - 0.05) < 1e-8


def test_formula_grammar():
    assert parse("y ~ a + b:c - d + 0", ["y", "a", "b", "c", "d"]) == ("y", [("a",), ("b", "c")], False)
    assert parse("y ~ . - c", ["y", "a", "b", "c"]) == ("y", [("a",), ("b",)], True)
    with pytest.raises(ValueError):
        parse("y + a", ["y", "a"])


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in "aab"], "value string")
    m = S.StringIndexer().fit(df)
    m.save(str(tmp_path / "m"))
    assert load_stage(str(tmp_path / "m")).labels == m.labels


def test_stages_work_in_pipelines(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(i, x) for i, x in enumerate("abca")], "id int, value string")
    m = Pipeline(stages=[S.StringIndexer(), S.OneHotEncoder(inputs=["index"], outputs=["o"])]).fit(df)
    assert column(m.transform(df), "o") == [[1, 0], [0, 1], [0, 0], [1, 0]]
