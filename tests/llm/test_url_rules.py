"""Mined url rules and their matches against counting all token subsets."""

import math
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from orrery.llm import urls


def test_rules_and_verdicts_against_all_subsets(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    h, p = urls.host_and_path(F.col("url"))
    rows = pages.select("page_id", h.alias("h"), p.alias("p")).select("page_id", urls.tokens(F.col("h"), F.col("p")).alias("t"), urls.fixed_verdict(F.col("h"), F.col("p")).alias("f")).collect()
    labelled = [(r.t, r.f.verdict) for r in rows if r.f]
    alone, both = Counter(), Counter()
    for t, v in labelled:
        for k in range(1, urls.LENGTH + 1):
            for c in combinations(sorted(t), k):
                alone[c] += 1
                both[c, v] += 1
    least = math.ceil(urls.SUPPORT * len(labelled))
    rules = {(c, v): (n / alone[c], n / len(labelled)) for (c, v), n in both.items() if n >= least and n / alone[c] >= urls.CONFIDENCE}
    kept = {
        (c, v): x for (c, v), x in rules.items()
        if not any((s, v) in rules and rules[s, v][0] >= x[0] for k in range(1, len(c)) for s in combinations(c, k))
    }
    mined = urls.mine(spark.createDataFrame([(list(t), v) for t, v in labelled], "items array<string>, verdict string"))
    got = {(tuple(sorted(r["items"])), r.verdict): (r.confidence, r.support) for r in mined.collect()}
    assert got == kept
    verdicts = {r.page_id: r.verdict for r in urls.filter_urls(pages).collect()}
    for r in rows:
        if r.f:
            want = r.f.verdict
        else:
            fired = [(x[0], x[1], len(c), v) for (c, v), x in kept.items() if set(c) <= set(r.t)]
            want = max(fired)[3] if fired else "allow"
        assert verdicts[r.page_id] == want
