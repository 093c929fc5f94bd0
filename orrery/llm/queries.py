"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import licenses, minhash, mixing, packing, quality, records, repeats, search, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.quantized(_table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return records.token_records(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("takes", lambda t: t.shard).alias("shards"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_search": op1_search,
        "op2_urls": op2_urls,
        "op3_quality": op3_quality,
        "op4_minhash": op4_minhash,
        "op5_toxicity": op5_toxicity,
        "op6_records": op6_records,
        "op7_licenses": op7_licenses,
        "op8_packing": op8_packing,
        "op9_mixing": op9_mixing,
        "op10_repeats": op10_repeats,
        "pipeline": pipeline,
    }


_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"

OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(x="coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), n AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality.STOP_WORDS)}], lower(x)))) AS n_stop_words,
    len(list_filter(w, lambda x: lower(x) <> upper(x))) AS n_letter_words
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), r AS (SELECT doc_id, count(*) AS n_repeat_words FROM rep GROUP BY doc_id),
j AS (
  SELECT n.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(r.n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM n LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop_words >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_letter_words >= 0.6 * n_words AS kept
FROM j
"""

def _sql_list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]::VARCHAR[]"


_PHRASE = "list_filter(range(0, greatest(len(w) - {n} + 1, 0)), lambda i: {same})"
_PHRASES = [
    _PHRASE.format(n=len(phrase.split()), same=" AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())))
    for phrase, _ in licenses.PHRASES
]
_FULL = 2**licenses.TEMPLATE_WORDS - 1

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT *, {", ".join(f"{sql} AS p{k}" for k, sql in enumerate(_PHRASES))} FROM d
), base AS (
  SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(_PHRASES)))}) AS places,
    list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES))}], lambda x: x IS NOT NULL))) AS base
  FROM b
), t(template, label, need, ban, tw) AS (
  VALUES {", ".join(f"({i}, '{label}', {_sql_list(need)}, {_sql_list(ban)}, {_sql_list(text)})" for i, (label, need, ban, text) in enumerate(licenses.TEMPLATES))}
), tg AS (
  SELECT template, len(tw) AS size, i AS tpos, tw[i + 1] || ' ' || tw[i + 2] || ' ' || tw[i + 3] AS g
  FROM (SELECT *, unnest(range(0, len(tw) - 2)) AS i FROM t)
), dg AS (
  SELECT rid, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
  FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d)
), diagonals AS (
  SELECT rid, template, size, pos - tpos AS diagonal, min(pos) AS low, max(pos) AS high, count(*) AS votes
  FROM dg JOIN tg USING (g) GROUP BY ALL
), steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > least({licenses.SLACK}, size // 3) THEN 1 ELSE 0 END AS step
  FROM diagonals
), runs AS (
  SELECT *, sum(step) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM steps
), spans AS (
  SELECT rid, template, size, min(low) AS low, max(high) + {licenses.GRAM} AS high FROM runs GROUP BY rid, template, size, run
  HAVING sum(votes) + {licenses.GRAM - 1} >= {licenses.COVERAGE / 2} * size AND max(high) - min(low) <= {licenses.STRETCH} * size
), parts AS (
  SELECT s.rid, t.label, t.tw, w[low + 1:high] AS part, CASE WHEN size <= {licenses.SHORT} THEN {licenses.SHORT_COVERAGE} ELSE {licenses.COVERAGE} END AS least
  FROM spans s JOIN t USING (template) JOIN d ON s.rid = d.rid
  WHERE len(list_filter(t.need, lambda x: NOT list_contains(w[low + 1:high], x))) = 0 AND NOT list_has_any(t.ban, w[low + 1:high])
), masked AS (
  SELECT rid, label, least, len(tw) AS size,
    list_transform(part, lambda x: CAST(list_sum(list_transform(range(0, len(tw)), lambda i: CASE WHEN tw[i + 1] = x THEN 1::BIGINT << i ELSE 0::BIGINT END)) AS BIGINT)) AS m
  FROM parts
), matched AS (
  SELECT rid, label, least,
    ({licenses.TEMPLATE_WORDS} - bit_count(list_reduce(list_concat([{_FULL}::BIGINT], m), lambda v, x: (((v + (v & x)) | (v & ~x)) & {_FULL}::BIGINT)))) / size::DOUBLE AS coverage
  FROM masked
), more AS (
  SELECT rid, list(DISTINCT label) AS more, max(coverage) AS coverage FROM matched WHERE coverage >= least GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN more USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_search": OP1, "op3_quality": OP3, "op7_licenses": OP7}
