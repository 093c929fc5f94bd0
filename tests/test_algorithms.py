"""Properties of iterative algorithms on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import boosting, embedding, graph, linear, matrices, networks, tuning
from orrery.operators.evaluation import BinaryClassificationEvaluator
from orrery.operators.statistics import sliding
from orrery.sources import graphs, vectors
from orrery.streaming.ab_test import StreamingFtrl, StreamingTest


def two_cliques(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    return spark.createDataFrame([*edges, (4, 10), (20, 0)], "src long, dst long")


def test_k_core_by_peeling(spark):
    got = {r.node: r.coreness for r in graph.k_core(two_cliques(spark)).collect()}
    assert got == {**dict.fromkeys([*range(5), *range(10, 15)], 4), 20: 1}


def test_k_core_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(410)]
    got = graph.k_core(spark.createDataFrame(chain, "src long, dst long"))
    assert got.count() == 411 and got.where("coreness <> 1").isEmpty()


def test_louvain_finds_cliques_and_raises_modularity(spark):
    e = two_cliques(spark).withColumn("weight", F.lit(1.0))
    c = graph.louvain(e, rounds=4, folds=2)
    got = {r.node: r.community for r in c.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    q = graph.modularity(e, c).first()[0]
    alone = graph.modularity(e, c.withColumn("community", F.col("node"))).first()[0]
    assert q > alone and all(got[n] == min(m for m in got if got[m] == got[n]) for n in got)


def test_page_rank_sums_to_nodes(spark):
    r = graph.page_rank(two_cliques(spark), rounds=3).agg(F.sum("rank"), F.count("*")).first()
    assert abs(r[0] - r[1]) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "a").write_text("1 1:1.0 3:2.0 5:3.0\n# note\n\n0\n0 2:4.0 4:5.0 6:6.0\n")
    df = vectors.read_libsvm(spark, str(tmp_path / "a"))
    assert [(r.label, r.features.size, r.features.indices) for r in df.collect()] == [(1, 6, [0, 2, 4]), (0, 6, []), (0, 6, [1, 3, 5])]
    dense = vectors.read_libsvm(spark, str(tmp_path / "a"), vector_type="dense").first().features
    assert dense == [1, 0, 2, 0, 3, 0]
    assert vectors.read_libsvm(spark, str(tmp_path / "a"), 100).first().features.size == 100
    with pytest.raises(ValueError):
        vectors.read_libsvm(spark, str(tmp_path / "a"), vector_type="other")
    (tmp_path / "bad").write_text("1 3:1.0 2:1.0\n")
    with pytest.raises(Exception, match="ascend"):
        vectors.read_libsvm(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "f").write_text("1 0:1:1.0 1:3:2.0 2:5:3.0\n0\n0 0:2:4.0 1:4:5.0 2:6:6.0\n")
    ffm = vectors.read_ffm(spark, str(tmp_path / "f"))
    assert ffm.first().features.size == 7
    assert {r.key: r.field for r in vectors.ffm_metadata(ffm).collect()} == {1: 0, 3: 1, 5: 2, 2: 0, 4: 1, 6: 2}
    (tmp_path / "e").write_text("1 2\n3  4\n")
    assert [(r.src, r.dst, r.weight) for r in graphs.read_edges(spark, str(tmp_path / "e")).collect()] == [(1, 2, 1.0), (3, 4, 1.0)]
    vectors.register_formats(spark)
    assert spark.read.format("libsvmex").option("path", str(tmp_path / "a")).load().count() == 3


def test_sliding(spark):
    df = spark.createDataFrame([(i * 3, float(i)) for i in range(7)], "k int, x double")
    got = {r.start: r.window for r in sliding(df, "k", "x", 3, 2).collect()}
    assert got == {0: [0, 1, 2], 2: [2, 3, 4], 4: [4, 5, 6]}


def separable(spark, n=200):
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, [float(v) for v in r], float(r[0] - r[1] > 0)) for i, r in enumerate(x)], "id int, features array<double>, label double")


def test_learners_and_cross_validation(spark):
    df = separable(spark).cache()
    learner = linear.LinearLearner(epochs=5)
    cv = tuning.CrossValidator(learner, tuning.param_grid({"rate": [1e-6, 1.0]}), BinaryClassificationEvaluator(), ["id"], k=2)
    model, best, means = cv.fit(df)
    assert best == {"rate": 1.0} and BinaryClassificationEvaluator().evaluate(model.transform(df)) > 0.95
    weighted = linear.LinearLearner(epochs=5, weight="w").fit(df.withColumn("w", F.col("label")))
    assert weighted.transform(df).where("prediction = 1").count() > 150


@pytest.mark.parametrize("name", ["logreg", "svm", "fm", "mixedlr", "dnn", "daw", "deepfm", "nfm", "pnn", "afm", "dcn"])
def test_network_gradients(name):
    """Backward agrees with finite differences."""
    spec, loss = networks.family(name, hidden=(4,))
    net = networks.Network(spec, 4, 4, seed=5)
    rng = np.random.Generator(np.random.PCG64(1))
    x, y = rng.normal(size=(6, 4)), rng.integers(0, 2, 6).astype(float)
    out, state = net.run(x)
    grads = net.backward(x, state, networks.loss_of(loss, out, y)[1])
    for k, p in net.params.items():
        flat = p.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[i]
            values = []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                values.append(networks.loss_of(loss, net.run(x)[0], y)[0].sum())
            flat[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-3, (name, k, i)


def test_network_training_lowers_loss(spark):
    spec, loss = networks.family("deepfm", hidden=(8,))
    m = networks.train_network(separable(spark), networks.Network(spec, 3, 3), loss, epochs=4, rate=0.05)
    assert m.history[-1] < m.history[0]
    again = networks.NetworkModel.from_json(m.to_json())
    assert again.transform(separable(spark)).where("prediction = label").count() > 120


def test_boosting_learns_and_scores_alike(spark):
    df = separable(spark)
    entries = df.select(F.col("id").alias("row_id"), F.posexplode("features").alias("fid", "value"))
    m = boosting.boost(entries, df.select(F.col("id").alias("row_id"), "label"), rounds=3, depth=2, rate=0.5)
    assert m.history[-1] < m.history[0] and set(m.importance()) <= {0, 1, 2}
    scored = df.withColumn("s", m.score(lambda f: F.get("features", f)))
    assert scored.where((F.col("s") > 0).cast("double") == F.col("label")).count() > 150


@pytest.mark.parametrize("row_share", [1.0, 0.9])
def test_absent_values_go_right_of_negative_thresholds(spark, row_share):
    entries = spark.createDataFrame([(i, 0, float(-1 - i % 40)) for i in range(200)], "row_id long, fid int, value double")
    labels = spark.createDataFrame([(i, int(i >= 200 or i % 40 < 10)) for i in range(400)], "row_id long, label int")
    m = boosting.boost(entries, labels, rounds=1, depth=1, row_share=row_share)
    (_, _, threshold, _), = m.trees[0].splits.values()
    absent, low = spark.range(1).select(m.score(lambda f: F.lit(None).cast("double")), m.score(lambda f: F.lit(-30.0))).first()
    assert threshold < 0 and absent > 0 > low
    right = [i for i in range(400) if i >= 200 or -1 - i % 40 >= threshold]
    if row_share == 1:
        y = [int(i >= 200 or i % 40 < 10) for i in right]
        assert abs(absent - 0.1 * sum(v - 0.5 for v in y) / (0.25 * len(y) + 1)) < 1e-9
    assert m.history[0] < np.log(2)


def _table_of(rng, n, classes=2):
    """Entries and labels: fid 0 has 40 values, fid 1 six categories with 0 among them, absent for a tenth of the rows."""
    x0, x1 = rng.integers(-20, 20, n).astype(float), rng.integers(0, 6, n).astype(float)
    y = ((x1 % classes) + (x0 > 5) + (rng.random(n) < 0.1)).astype(int) % classes
    absent = rng.random(n) < 0.1
    entries = [(i, 0, float(x0[i])) for i in range(n)] + [(i, 1, float(x1[i])) for i in range(n) if not absent[i]]
    return entries, y, x0, np.where(absent, np.nan, x1)


@pytest.mark.parametrize("classes, hessian", [(0, "diagonal"), (3, "diagonal"), (3, "full")])
def test_first_split_of_a_tree_against_all_divisions(spark, classes, hessian):
    """The root's split against the rule worked out row by row, for one and for several classes."""
    rng = np.random.Generator(np.random.PCG64(3))
    entries, y, x0, x1 = _table_of(rng, 400, max(classes, 2))
    e = spark.createDataFrame(entries, "row_id long, fid int, value double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, label int")
    m = boosting.boost(e, labels, "multinomial" if classes else "logistic", rounds=1, depth=1, rate=1.0, classes=classes, hessian=hessian)
    k = classes or 1
    p = 1 / max(classes, 2)
    g = p - np.eye(classes)[y] if classes else (0.5 - y)[:, None]
    if hessian == "full":
        h = np.full((len(y), 6), 0.0) + np.where(np.arange(6)[None] * 0 + np.isin(np.arange(6), [0, 3, 5]), p * (1 - p), -p * p)
        g = p - np.eye(classes)[y]
    else:
        h = np.full((len(y), k), p * (1 - p))

    def gain(rows):
        a, b = g[rows].sum(0), h[rows].sum(0)
        if hessian == "full":
            full = np.zeros((3, 3))
            full[np.triu_indices(3)] = b
            full = full + np.triu(full, 1).T + np.eye(3)
            return a @ np.linalg.inv(full) @ a
        return (a * a / (b + 1)).sum()

    every = np.ones(len(y), bool)
    points = sorted({r for r in boosting.candidate_splits(e).where("fid = 0").first().splits})
    best = []
    for t in points[1:]:
        left = x0 < t
        best.append((gain(left) + gain(~left) - gain(every) - 1, 0, left))
    left = np.isnan(x1) | (x1 == 0)
    for c in range(1, 6):
        a = g[x1 == c].sum(0)
        if a @ (2 * g[left].sum(0) + a - g.sum(0)) >= 0:
            left = left | (x1 == c)
    best.append((gain(left) + gain(~left) - gain(every) - 1, 1, left))
    want = max(best, key=lambda b: (b[0], -b[1]))
    tree = m.trees[0]
    assert tree.splits[0][0] == want[1] and tree.splits[0][3] == pytest.approx(want[0])
    rows = spark.createDataFrame([(i, float(x0[i]), None if np.isnan(x1[i]) else float(x1[i])) for i in range(len(y))], "i int, x0 double, x1 double")
    got = rows.select("i", m.score(lambda f: F.col(f"x{f}")).alias("s")).collect()
    value = lambda s: tuple(s) if classes else s
    assert len({value(r.s) for r in got if want[2][r.i]}) == len({value(r.s) for r in got if not want[2][r.i]}) == 1
    if hessian == "diagonal":
        a, b = g[want[2]].sum(0), h[want[2]].sum(0)
        some = next(r.s for r in got if want[2][r.i])
        assert np.allclose(some if classes else [some], -a / (b + 1))


def test_boosted_classes_sampling_and_storage(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(4))
    entries, y, x0, x1 = _table_of(rng, 300, 3)
    e = spark.createDataFrame(entries, "row_id long, fid int, value double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, label int")
    m = boosting.boost(e, labels, "multinomial", rounds=3, depth=3, rate=0.5, classes=3, feature_share=0.9, max_leaves=5)
    assert m.history[-1] < np.log(3) and all(len(t.leaves) <= 5 for t in m.trees)
    m.save(spark, str(tmp_path / "model"))
    again = boosting.BoostedModel.load(spark, str(tmp_path / "model"))
    rows = spark.createDataFrame([(i, float(x0[i]), None if np.isnan(x1[i]) else float(x1[i]), int(y[i])) for i in range(300)], "i int, x0 double, x1 double, label int")
    value = lambda f: F.col(f"x{f}")
    got = rows.select("label", m.score(value).alias("score"), again.score(value).alias("again"), m.predict(value).alias("c")).collect()
    assert all(list(r.score) == list(r.again) for r in got) and sum(r.c == r.label for r in got) > 200
    loss = np.mean([np.log(np.exp(r.score).sum()) - r.score[r.label] for r in got])
    assert loss == pytest.approx(m.history[-1])
    scored = rows.select("label", m.score(value).alias("score"))
    assert boosting.metric(scored, "precision", 3) == pytest.approx(np.mean([r.c == r.label for r in got]))


def test_trees_after_the_best_round_are_dropped(spark, monkeypatch):
    df = separable(spark)
    entries = df.select(F.col("id").alias("row_id"), F.posexplode("features").alias("fid", "value"))
    losses = iter([0.5, 0.3, 0.4, 0.45, 0.46])
    monkeypatch.setattr(boosting, "metric", lambda *a: next(losses))
    m = boosting.boost(entries, df.select(F.col("id").alias("row_id"), "label"), rounds=5, depth=1)
    assert len(m.trees) == 2 and len(m.history) == 5


def test_small_nodes_are_leaves(spark):
    df = separable(spark)
    entries = df.select(F.col("id").alias("row_id"), F.posexplode("features").alias("fid", "value"))
    m = boosting.boost(entries, df.select(F.col("id").alias("row_id"), "label"), rounds=1, depth=4, min_rows=10_000)
    assert m.trees[0].splits == {} and set(m.trees[0].leaves) == {0}


def test_embedding_loss_falls(spark):
    e = two_cliques(spark)
    for order in (1, 2):
        assert (h := embedding.line(e, 21, 4, order, epochs=4)[1])[-1] < h[0]
    s = spark.createDataFrame([([1, 2, 3, 1, 2],), ([4, 5, 4, 5, 6],)] * 10, "words array<long>")
    for model in ("skipgram", "cbow"):
        assert (h := embedding.word2vec(s, 7, 4, epochs=4, model=model)[1])[-1] < h[0]


def test_matrices_agree_with_numpy(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    assert np.allclose(matrices.svd(df, "v", 3, 3)[0], np.linalg.svd(x)[1])
    r = matrices.qr(df, "v", 3)
    assert np.allclose(r.T @ r, x.T @ x)
    share = matrices.pca(df, "v", 3, 3)[1]
    assert abs(share.sum() - 1) < 1e-9


def test_auto_tuner():
    for strategy in ("grid", "random", "gaussian"):
        best, score = tuning.AutoTuner({"x": (0.0, 1.0)}, strategy).run(lambda p: -((p["x"] - 0.3) ** 2), 15)
        assert score > -0.05


def test_streaming_test_and_ftrl(spark):
    test = StreamingTest(peace=1, window=2)
    for k in range(4):
        test.update(spark.createDataFrame([(i % 2 == 0, float(i % 7) + (i % 2)) for i in range(40 + k)], "experiment boolean, value double"), k)
    assert test.result["n"] == {True: 43, False: 42} and 0 <= test.result["p_value"] <= 1
    state = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "idx long, z double, n double")
    f = StreamingFtrl(state, lambda1=0.01)
    batch = spark.createDataFrame([(i, float(i % 2), [i % 2], [1.0]) for i in range(20)], "row_id long, label double, indices array<long>, values array<double>")
    for k in range(3):
        f.update(batch, k)
    w = {r.idx: r.value for r in f.weights().collect()}
    assert w[1] > 0 > w[0]


def test_recall_of_the_approximate_search(spark):
    """Every query of the registered search against brute force: recall of at least 0.9."""
    from orrery.plans import catalog

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = set()
    for q, v in rows:
        if q % 100 == 0:
            want |= {(q, i) for _, i in sorted((float(((v - x) ** 2).sum()), i) for i, x in rows if i != q)[:10]}
    got = {(r.query, r.id) for r in catalog.queries()["ann"](spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_pairs_of_a_sentence_and_falling_loss_in_tables(spark):
    from orrery.operators import embedding_table

    s = spark.createDataFrame([([5, 6, 7, 5],), ([8],), ([],), (None,)], "words array<long>")
    got = sorted(tuple(r) for r in embedding_table.skipgram_pairs(s, 2).collect())
    words = [5, 6, 7, 5]
    assert got == sorted((words[i], words[j]) for i in range(4) for j in range(4) if i != j and abs(i - j) <= 2)
    edges = two_cliques(spark)
    ids = spark.range(21).select(F.col("id").alias("idx"))
    for order in (1, 2):
        table, losses = embedding_table.line(edges, ids, dim=4, order=order, negatives=2, epochs=5, rate=1.0)
        assert losses[-1] < losses[0] and table.count() == 21
    alone = {r.idx: r.vector for r in table.collect()}
    # a node without edges is only ever a negative: its input vector stays as it was
    assert np.allclose(alone[15], embedding_table.first_vectors(ids, 4).where("idx = 15").first().vector)
