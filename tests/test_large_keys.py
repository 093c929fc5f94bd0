"""Queries at keys and sizes of large tables."""

import duckdb
import pytest

from orrery.plans import catalog


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """Lines whose parts are numbered from 999,990 on, so that most of them are also supplier nodes."""
    folder = tmp_path_factory.mktemp("shifted")
    rows = [(k, 999_990 + k * 7 % 40, k * k % 23) for k in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_common_neighbours_of_suppliers_only(spark, shifted):
    got = sorted(tuple(r) for r in catalog.queries()["common_neighbours"](spark, shifted).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{shifted}/lineitem.parquet/*.parquet'")
    want = db.execute(f"SELECT a, b, n FROM ({catalog.oracle_sql()['common_neighbours']})").fetchall()
    assert got == sorted(want) and sum(r[2] for r in got) > 0


def test_quantiles_are_exact_nearest_ranks(spark):
    """Ranks from decimals as written, nulls left out, repeated values, whole tables of counts."""
    from orrery.operators import statistics

    asked = []
    real = statistics.running_total
    statistics.running_total = lambda df, *a: asked.append(df.columns) or real(df, *a)
    try:
        for n, values in ((30, range(30)), (200, [i * i % 17 / 4 for i in range(200)])):
            df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
            got = [tuple(r) for r in statistics.quantiles(df, "v", [0.1, 0.5, 0.9, 0.0, 1.0, 0.1]).collect()]
            high = sorted(float(v) for v in values)
            ranks = {0.1: n // 10, 0.5: n // 2, 0.9: n * 9 // 10, 0.0: 1, 1.0: n}
            assert sorted(got) == sorted((q, high[ranks[q] - 1]) for q in (0.1, 0.5, 0.9, 0.0, 1.0, 0.1))
        empty = spark.createDataFrame([(None,)], "v double")
        assert [tuple(r) for r in statistics.quantiles(empty, "v", [0.5]).collect()] == [(0.5, None)]
    finally:
        statistics.running_total = real
    assert asked and all(c == ["value", "n"] for c in asked)  # counts of values, no sketch of all rows


def test_hyper_anf_goes_on_until_nothing_grows(spark, tmp_path):
    """A chain of 16 nodes, part and supplier in turn: 15 hops from end to end."""
    rows = [(k, k // 2 + k % 2, k // 2) for k in range(15)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.closeness for r in catalog.queries()["hyper_anf"](spark, str(tmp_path)).collect()}
    assert len(got) == 16
    assert got[0] == pytest.approx(15 * 16 / 2, rel=0.05)  # 1 + 2 + ... + 15; four hops give 10, ten give 55
