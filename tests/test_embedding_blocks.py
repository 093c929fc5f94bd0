"""LINE and skip-gram over blocks of vectors, against plain numpy and plain Python."""

import numpy as np
import pytest

from orrery.operators import embedding
from orrery.plans import catalog


def test_line_steps_against_numpy(spark):
    """Two epochs over three blocks and several slices, without drawn negatives: nothing random is left but the start."""
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 250, (900, 2)), axis=0)
    edges = spark.createDataFrame([tuple(int(x) for x in p) for p in pairs], "src long, dst long").repartition(5)
    start = {r.node: r.vector for r in embedding.line_vectors(edges, 250, 3, epochs=0, block=100)[0].collect()}
    for order in (1, 2):
        table, losses = embedding.line_vectors(edges, 250, 3, order, negatives=0, rate=0.5, epochs=2, block=100)
        got = {r.node: r.vector for r in table.collect()}
        a = np.array([start[i] for i in range(250)])
        b = a if order == 1 else np.zeros_like(a)
        left, right = pairs.T
        for loss in losses:
            p = 1 / (1 + np.exp(-(a[left] * b[right]).sum(1)))
            assert loss == pytest.approx(-np.log(p).mean(), rel=1e-5)
            ga, gb = np.zeros_like(a), np.zeros_like(a)
            np.add.at(ga, left, (p - 1)[:, None] * b[right])
            np.add.at(gb, right, (p - 1)[:, None] * a[left])
            ga /= np.maximum(np.sqrt(np.bincount(left, minlength=250)), 1)[:, None]
            gb /= np.maximum(np.sqrt(np.bincount(right, minlength=250)), 1)[:, None]
            if order == 1:
                a = b = a - 0.5 * (ga + gb) / 2
            else:
                a, b = a - 0.5 * ga, b - 0.5 * gb
        assert np.allclose([got[i] for i in range(250)], a, atol=1e-5)


def test_gradients_with_negatives_against_numpy():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 4, 30)).astype(np.float32)
    left, right = rng.integers(0, 30, (2, 200))
    into = np.zeros((4, 30)), np.zeros((4, 30)), np.zeros(30), np.zeros(30)
    loss, n = embedding._sampled(a, b, left, right, 5, np.random.default_rng(9), into)
    target = np.random.default_rng(9).integers(0, 30, (6, 200))
    target[0] = right
    ga, gb, ca, cb, total = np.zeros((4, 30)), np.zeros((4, 30)), np.zeros(30), np.zeros(30), 0.0
    for j in range(6):
        for i, (x, z) in enumerate(zip(left, target[j], strict=True)):
            if j and z in (x, right[i]):
                continue
            p = 1 / (1 + np.exp(-float(a[:, x] @ b[:, z])))
            total -= np.log(1 - p if j else p)
            ga[:, x] += (p - (j == 0)) * b[:, z]
            gb[:, z] += (p - (j == 0)) * a[:, x]
            ca[x] += 1
            cb[z] += 1
    assert loss == pytest.approx(total, rel=1e-4) and n == ca.sum()
    assert all(np.allclose(x, y, atol=1e-3) for x, y in zip(into, (ga, gb, ca, cb), strict=True))


def test_contexts_of_many_sentences_at_once():
    """With reaches of one (window 1) each neighbour in a sentence is paired both ways, and none across sentences."""
    words, lengths = np.array([7, 8, 9, 1, 2, 5], np.int32), np.array([3, 0, 2, 1], np.int32)
    left, right = embedding._contexts(1, "skipgram")(words, lengths, np.random.default_rng(1))
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 2), (2, 1), (7, 8), (8, 7), (8, 9), (9, 8)]
    left, right = embedding._contexts(3, "skipgram")(np.arange(4000, dtype=np.int32), np.full(1000, 4, np.int32), np.random.default_rng(1))
    pairs = set(zip(left.tolist(), right.tolist(), strict=True))
    assert all(x // 4 == y // 4 and x != y for x, y in pairs)
    assert 300 < sum(abs(x - y) == 3 for x, y in pairs) < 1000 and len([p for p in pairs if abs(p[0] - p[1]) == 1]) == 6000


@pytest.mark.parametrize("name", ["line_embedding", "word2vec"])
def test_queries_keep_vectors_off_the_driver(spark, sf, monkeypatch, name):
    broadcast = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: broadcast.append(x))
    df = catalog.queries()[name](spark, sf)
    assert not broadcast and "LocalTableScan" not in df._jdf.queryExecution().toString()
    assert df.where("dim <> 8").isEmpty() and not df.isEmpty()
