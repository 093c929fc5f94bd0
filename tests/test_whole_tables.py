"""Queries over whole tables, against counts and plain Python on the smallest tables."""

import numpy as np

from orrery.operators import boosting, graph
from orrery.plans import catalog, q_graph, q_models
from orrery.sources import vectors


def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def distances(near, source):
    out, front = {source: 0}, [source]
    while front:
        front = list({b for a in front for b in near[a]} - out.keys())
        out |= dict.fromkeys(front, max(out.values()) + 1)
    return out


def test_closeness_of_every_node(spark, sf):
    pairs = [tuple(r) for r in q_graph._edges(table(spark, sf)).collect()]
    got = {r.node: (r.reached, r.total) for r in catalog.queries()["closeness_bfs"](spark, sf).collect()}
    near = neighbours(pairs)
    want = {n: distances(near, n) for n in near}
    assert got == {n: (len(d) - 1, sum(d.values())) for n, d in want.items()}


def test_closeness_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(70)] + [(500, 501)]
    got = {r.node: (r.reached, r.total) for r in graph.closeness_all(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got[0] == (70, 70 * 71 // 2) and got[500] == (1, 1) and len(got) == 73


def test_louvain_takes_all_edges(spark, sf):
    got = {r.node for r in catalog.queries()["louvain"](spark, sf).select("node").collect()}
    assert got == {n for r in q_graph._edges(table(spark, sf)).collect() for n in r}


def test_formats_read_back_every_line(spark, sf, monkeypatch):
    lines = table(spark, sf)("lineitem").count()
    written = []
    for name in ("write_libsvm", "write_ffm"):
        monkeypatch.setattr(vectors, name, lambda df, path, f=getattr(vectors, name): (written.append(df.count()), f(df, path)))
    for name in ("libsvm_width", "ffm_meta"):
        assert catalog.queries()[name](spark, sf).count() > 0
    assert written == [lines, lines]
    for name in ("libsvm_roundtrip", "ffm_roundtrip"):
        assert catalog.queries()[name](spark, sf).count() == lines


def test_embeddings_have_every_node(spark, sf):
    nodes = {n for r in q_graph._edges(table(spark, sf)).collect() for n in r}
    got = catalog.queries()["line_embedding"](spark, sf).collect()
    assert {r.node for r in got} == nodes and len(got) == len(nodes)
    parts = {r[0] for r in table(spark, sf)("lineitem").select("l_partkey").collect()}
    got = catalog.queries()["word2vec"](spark, sf).collect()
    assert {r.node for r in got} == parts and len(got) == len(parts)


def test_minhash_join_against_all_pairs(spark, sf):
    orders = {}
    for k, p in table(spark, sf)("lineitem").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(k, set()).add(p)
    sign = {k: [min(((i + 1) * a + b) % 2038074743 for i in p) for a, b in q_models._COEF] for k, p in orders.items()}
    by = {}
    for k, h in sign.items():
        for x in enumerate(h):
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    far = {(a, b): 1 - len(orders[a] & orders[b]) / len(orders[a] | orders[b]) for a, b in pairs}
    got = {(r.ia, r.ib): r.distance for r in catalog.queries()["minhash_join"](spark, sf).collect()}
    assert got == {k: round(d, 6) for k, d in far.items() if d < 0.5} and got


def test_bins_and_root_split_of_all_features(spark, sf):
    t = table(spark, sf)
    splits = {r.fid: np.array(r.splits) for r in boosting.candidate_splits(q_models._features(t)).collect()}
    y = {r.row_id: r.g for r in q_models._rows(t).collect()}
    hist = {}
    for r in q_models._features(t).collect():
        b = max(int((splits[r.fid] <= r.value).sum()) - 1, 0)
        n, g = hist.get((r.fid, b), (0, 0.0))
        hist[r.fid, b] = (n + 1, g + y[r.row_id])
    q = catalog.queries()
    assert {(r.fid, r.bin): r.n for r in q["gbdt_bins"](spark, sf).collect()} == {k: n for k, (n, _) in hist.items()}
    got = {(r.fid, r.bin): r.g for r in q["gbdt_histogram"](spark, sf).collect()}
    assert got.keys() == hist.keys() and all(abs(got[k] - hist[k][1]) < 1e-9 for k in hist)
    g, h = sum(y.values()), 0.25 * len(y)
    gains = {}
    for f, b in hist:
        left = [v for (f2, b2), v in hist.items() if f2 == f and b2 <= b]
        gl, hl = sum(v[1] for v in left), 0.25 * sum(v[0] for v in left)
        if h - hl > 1e-12:
            gains[f, b] = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1) - 1
    best = q["gbdt_root_split"](spark, sf).first()
    assert abs(best.gain - max(gains.values())) < 1e-3 and abs(gains[best.fid, best.bin] - best.gain) < 1e-3
