"""The corpus pipeline: stages take effect on their own input, and DuckDB agrees on queries with SQL."""

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from orrery.llm import queries as Q
from orrery.plans.storage import cut

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import base_text, brute_mix, brute_repeats, exact_components  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        assert docs.columns == list(P.COLUMNS)
        assert docs.where(F.col("n_chars") != F.length("text")).isEmpty()
        if name != "mixing":
            assert docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").isEmpty()
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() <= n
    assert packed.groupBy("shard", "bin").agg(F.sum("size").alias("s")).where("s > 2048").isEmpty()


def test_stages_against_brute_force(spark, sf):
    """Near duplicates, repeats, mix and packing, each on the input that its predecessor left, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {name: (docs := cut(stage(spark, docs, sf), name)) for name, stage in P.STAGES[:-1]}
    rows = lambda name: {r.doc_id: r for r in kept[name].collect()}
    before, after = rows("toxicity"), rows("near_duplicates")
    components, _ = exact_components([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, c in components.items() if i == c}
    assert all(after[i] == before[i] for i in after)
    want = brute_repeats([(i, r.text) for i, r in after.items()], 100)
    cleaned = rows("repeats")
    for i, (_, gone, _, rest) in want.items():
        text = rest.decode(errors="ignore").replace("\ufffd", "")
        assert (i not in cleaned) == (gone > 0 and not text)
        if i in cleaned:
            assert cleaned[i].text == (text if gone else after[i].text)
    mix = brute_mix([(i, r.text, r.source) for i, r in cleaned.items()], None, 9, 1024)
    pieces = lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
    expected = Counter((i, cleaned[i].text if n == size else "".join(pieces(cleaned[i].text)[:n])) for i, (size, _, _, takes) in mix.items() for _, n in takes)
    mixed = kept["mixing"].collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == expected
    bins = {}
    for r in P.STAGES[-1][1](spark, docs, sf).collect():
        bins.setdefault((r.shard, r.bin), []).append(r)
    words = sum(len(pieces(r.text)) for r in mixed)
    assert sum(r["size"] for many in bins.values() for r in many) == words
    for many in bins.values():
        assert sum(r["size"] for r in many) <= 2048
        for column in ("source", "cluster"):
            names = [r[column] for r in many if r[column] is not None]
            assert len(names) == len(set(names)), column


def test_rows_that_repeat_a_doc_id_keep_their_own_fate(spark, sf):
    a, b = base_text(1, 60), base_text(2, 60)
    rows = [(3, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "de", "s", 1), (None, b, "en", "s", 1), (8, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(P.drop_near_duplicates(spark, docs, sf).collect(), key=str)
    assert [(r.doc_id, r.text, r.lang) for r in got] == sorted([(3, a, "en"), (7, b, "de"), (None, b, "en"), (8, None, "en")], key=lambda r: str(next(x for x in got if (x.doc_id, x.text, x.lang) == r)))


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]}) AS q").fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want
