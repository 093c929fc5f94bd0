"""Queries of the text transformers and dictionaries."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import text as T
from orrery.plans.registry import query

# split at single white-space characters, empty tokens at the end left out
_TOKENS = """SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: x <> '')) = 0 THEN [] ELSE w[:list_aggregate(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] <> '' THEN i ELSE 0 END), 'max')] END AS w
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\\s') AS w FROM documents)"""
_PLAIN = "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 1) AS w FROM documents"


def _tokens(t) -> DataFrame:
    return T.RegexTokenizer(input="text", output="w").transform(t("documents").select("doc_id", "text")).select("doc_id", "w")


def _exploded(df: DataFrame, column: str = "w") -> DataFrame:
    return df.select("doc_id", F.explode(column).alias("token"))


@query("tokenizer", f"SELECT doc_id, unnest(w) AS token FROM ({_TOKENS})")
def _(t, spark):
    return _exploded(T.Tokenizer(input="text", output="w").transform(t("documents")))


@query("regex_tokenizer", f"SELECT doc_id, unnest(w) AS token FROM ({_PLAIN})")
def _(t, spark):
    return _exploded(_tokens(t))


@query("regex_tokenizer_match", "SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) AS token FROM conversations")
def _(t, spark):
    r = T.RegexTokenizer(input="text", output="w", pattern="[a-z]+", gaps=False, min_length=3)
    return r.transform(t("conversations")).select("conv_id", "turn", F.explode("w").alias("token"))


@query("ngram", f"SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ({_PLAIN}))")
def _(t, spark):
    return _exploded(T.NGram(input="w", output="g", n=3).transform(_tokens(t)), "g")


@query("stop_words", f"SELECT doc_id, unnest(list_filter(w, lambda x: lower(x) NOT IN ('the', 'of', 'and', 'to', 'la', 'der'))) AS token FROM ({_PLAIN})")
def _(t, spark):
    s = T.StopWordsRemover(input="w", output="k", stop_words=["The", "of", "and", "to", "la", "der"])
    return _exploded(s.transform(_tokens(t)), "k")


def _english_sql() -> str | None:
    """The query's SQL with the list that Spark's own jar holds; None without that jar."""
    jars = sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar"))
    if not jars:
        return None
    words = zipfile.ZipFile(jars[0]).read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")
    listed = ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words if w)
    return f"SELECT doc_id, unnest(list_filter(w, lambda x: lower(x) NOT IN ({listed}))) AS token FROM ({_PLAIN})"


@query("stop_words_english", _english_sql())
def _(t, spark):
    return _exploded(T.StopWordsRemover(input="w", output="k").transform(_tokens(t)), "k")


_COUNTS = f"counts AS (SELECT doc_id, token AS term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS token FROM ({_PLAIN})) GROUP BY ALL)"
_VOCABULARY = f"WITH {_COUNTS}, v AS (SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2)"


@query("count_vectorizer_vocabulary", f"{_VOCABULARY} SELECT term, total, df, CAST(row_number() OVER (ORDER BY total DESC, term) - 1 AS INTEGER) AS idx FROM v ORDER BY total DESC, term LIMIT 500")
def _(t, spark):
    return T.vocabulary(T.term_counts(_tokens(t), "doc_id", "w"), 0, size=500, min_df=2)


_TOP = f"{_VOCABULARY}, top AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS idx FROM v ORDER BY total DESC, term LIMIT 100)"


@query("count_vectorizer", f"{_TOP} SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(n AS DOUBLE) AS value FROM counts JOIN top USING (term)")
def _(t, spark):
    df = _tokens(t)
    m = T.CountVectorizer(input="w", output="c", size=100, min_df=2).fit(df)
    return m.transform(df).select("doc_id", F.explode(F.arrays_zip(F.col("c.indices").alias("idx"), F.col("c.values").alias("value"))).alias("e")).select("doc_id", "e.idx", "e.value")


@query("idf", f"WITH {_COUNTS} SELECT term, count(*) AS df, round(ln((SELECT count(*) + 1.0 FROM documents) / (count(*) + 1.0)), 6) AS idf FROM counts GROUP BY term")
def _(t, spark):
    counts = T.term_counts(_tokens(t), "doc_id", "w").select("row_id", F.col("term").alias("idx"), F.col("n").alias("value"))
    return T.inverse_document_frequency(counts, t("documents").count()).select(F.col("idx").alias("term"), "df", F.round("idf", 6).alias("idf"))


@query("tf_idf", f"WITH {_COUNTS}, i AS (SELECT term, ln((SELECT count(*) + 1.0 FROM documents) / (count(*) + 1.0)) AS idf FROM counts GROUP BY term) SELECT doc_id, term, round(n * idf, 5) AS value FROM counts JOIN i USING (term)")
def _(t, spark):
    counts = T.term_counts(_tokens(t), "doc_id", "w").select("row_id", F.col("term").alias("idx"), F.col("n").alias("value"))
    out = T.tf_idf(counts, T.inverse_document_frequency(counts, t("documents").count()))
    return out.select(F.col("row_id").alias("doc_id"), F.col("idx").alias("term"), F.round("value", 5).alias("value"))


@query("hashing_tf", f"SELECT doc_id, CAST(len(w) AS DOUBLE) AS total FROM ({_PLAIN})")
def _(t, spark):
    # hashes have no SQL form; the counts add up to the number of tokens, whatever collides
    h = T.HashingTF(input="w", output="tf", size=1 << 12).transform(_tokens(t))
    return h.select("doc_id", F.aggregate("tf.values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("corpus_dictionary", "SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\\s+|,]')) AS word FROM documents) WHERE word <> ''")
def _(t, spark):
    return T.corpus_dictionary(t("documents"), "text")


@query("corpus_encoded", """WITH w AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\s+|,]')) AS word FROM documents) WHERE word <> ''),
  d AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM w)) SELECT doc_id, word_id, count(*) AS n FROM w JOIN d USING (word) GROUP BY ALL""")
def _(t, spark):
    words = t("documents").select("doc_id", F.explode(F.split("text", r"[\s+|,]")).alias("word")).where("word <> ''")
    return words.join(T.corpus_dictionary(t("documents"), "text"), "word").groupBy("doc_id", "word_id").agg(F.count("*").alias("n"))


@query("subsampling_prob", f"WITH {_COUNTS}, w AS (SELECT term AS word, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY term), z AS (SELECT word, n, n / sum(n) OVER () AS z FROM w) SELECT word, n, round(least(1.0, (sqrt(z / 1e-3) + 1) * 1e-3 / z), 6) AS keep FROM z")
def _(t, spark):
    words = T.term_counts(_tokens(t), "doc_id", "w").groupBy(F.col("term").alias("word")).agg(F.sum("n").alias("n"))
    return T.subsampling_probability(words).select("word", "n", F.round("keep", 6).alias("keep"))


@query("subsample")
def _(t, spark):
    tokens = _tokens(t).select(F.col("doc_id").alias("row_id"), F.posexplode("w").alias("pos", "word"))
    return T.subsample(tokens, T.subsampling_probability(tokens.groupBy("word").agg(F.count("*").alias("n"))))
