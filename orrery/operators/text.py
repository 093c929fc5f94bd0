"""Text transformers: tokens, n-grams, stop words, term vectors, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import vectors as V
from orrery.functions.vectors import let
from orrery.operators.stage import Fitter, Stage
from orrery.operators.vector import merged
from orrery.plans.storage import cut


def _without_trailing(tokens: Column) -> Column:
    """Without the empty strings at the end."""
    flags = F.transform(tokens, lambda t: F.when(t != "", 1).otherwise(0))
    last = F.size(tokens) - F.coalesce(F.array_position(F.reverse(flags), 1), F.lit(0)) + 1
    return F.when(F.array_max(flags) == 1, F.slice(tokens, F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<string>"))


class Tokenizer(Stage):
    """Lower-cased, split at every single white-space character; empty tokens at the end go."""

    params = {"input": "text", "output": "tokens"}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, _without_trailing(F.split(F.lower(self.input), r"\s")))


class RegexTokenizer(Stage):
    params = {"input": "text", "output": "tokens", "pattern": r"\s+", "gaps": True, "min_length": 1, "lower": True}

    def apply(self, df: DataFrame) -> DataFrame:
        text = F.lower(self.input) if self.lower else F.col(self.input)
        found = F.split(text, self.pattern) if self.gaps else F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        return df.withColumn(self.output, F.filter(found, lambda t: F.length(t) >= self.min_length))


class NGram(Stage):
    params = {"input": "tokens", "output": "ngrams", "n": 2}

    def apply(self, df: DataFrame) -> DataFrame:
        def grams(tokens: Column) -> Column:
            count = F.size(tokens) - (self.n - 1)
            one = lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(self.n)])
            return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<string>"))

        return df.withColumn(self.output, let(F.col(self.input), grams))


class StopWordsRemover(Stage):
    """Without stop words, ignoring case unless told otherwise; null tokens stay. Lists of a
    language come with Spark."""

    params = {"input": "tokens", "output": "filtered", "stop_words": None, "language": "english", "case_sensitive": False}

    def apply(self, df: DataFrame) -> DataFrame:
        words = self.stop_words
        if words is None:
            from pyspark.ml.feature import StopWordsRemover as Stock

            words = Stock.loadDefaultStopWords(self.language)
        same = (lambda t: t) if self.case_sensitive else F.lower
        words = words if self.case_sensitive else sorted({w.lower() for w in words})
        return df.withColumn(self.output, F.filter(self.input, lambda t: t.isNull() | ~same(t).isin(*words)) if words else F.col(self.input))


class HashingTF(Stage):
    """Term counts (or 1 with ``binary``) at pmod(murmur3(term), size), as a sparse vector."""

    params = {"input": "tokens", "output": "tf", "size": 1 << 18, "binary": False}

    def apply(self, df: DataFrame) -> DataFrame:
        entry = lambda t: F.struct(F.pmod(F.hash(t), F.lit(self.size)).cast("long").alias("i"), F.lit(1.0).alias("x"))
        v = merged(F.transform(self.input, entry), self.size)
        if self.binary:
            v = v.withField("values", F.transform(v["values"], lambda _: F.lit(1.0)))
        return df.withColumn(self.output, v)


def term_counts(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """(row_id, term, n) in long form."""
    return df.select(F.col(row_id).alias("row_id"), F.explode(tokens).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, n_docs: int, size: int = 1 << 18, min_df: float = 1.0, max_df: float = float("inf")) -> DataFrame:
    """(term, total, df, idx): the most frequent terms whose document frequency is within bounds
    (counts from 1 on, shares below), ties by the alphabet."""
    low = min_df if min_df >= 1 else min_df * n_docs
    high = max_df if max_df >= 1 else max_df * n_docs
    terms = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")).where((F.col("df") >= low) & (F.col("df") <= high))
    top = terms.orderBy(F.desc("total"), "term").limit(size)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1)


class CountVectorizerModel(Stage):
    """Adds the sparse count vector of each row. Tokens meet the vocabulary in a join; ``row_id``
    identifies rows."""

    params = {"input": "tokens", "output": "counts", "row_id": "doc_id", "vocabulary": [], "min_tf": 1.0, "binary": False}

    def apply(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        words = F.broadcast(spark.createDataFrame(list(zip(self.vocabulary, range(len(self.vocabulary)), strict=True)), "term string, i long"))
        least = F.lit(float(self.min_tf)) if self.min_tf >= 1 else F.lit(self.min_tf) * F.col("__size")
        tokens = df.select(F.col(self.row_id).alias("__row"), F.size(self.input).alias("__size"), F.explode(self.input).alias("term"))
        counts = tokens.join(words, "term").groupBy("__row", "__size", "i").agg(F.count("*").cast("double").alias("x")).where(F.col("x") >= least)
        e = F.array_sort(F.collect_list(F.struct("i", F.lit(1.0).alias("x") if self.binary else F.col("x"))))
        rows = counts.groupBy("__row").agg(e.alias("__e"))
        empty = F.array().cast("array<struct<i:bigint,x:double>>")
        out = V.let(F.coalesce("__e", empty), lambda e: F.struct(
            F.lit(len(self.vocabulary)).cast("long").alias("size"), F.transform(e, lambda y: y.i).alias("indices"), F.transform(e, lambda y: y.x).alias("values")
        ))
        return df.join(rows, F.col(self.row_id) == F.col("__row"), "left").withColumn(self.output, out).drop("__row", "__e")


class CountVectorizer(Fitter):
    """A vocabulary held in the model; for very large ones join ``vocabulary`` in long form."""

    params = {"input": "tokens", "output": "counts", "row_id": "doc_id", "size": 1 << 18, "min_df": 1.0, "max_df": float("inf"), "min_tf": 1.0, "binary": False}

    def learn(self, df: DataFrame) -> CountVectorizerModel:
        terms = vocabulary(term_counts(df, self.row_id, self.input), df.count(), self.size, self.min_df, self.max_df)
        words = [r.term for r in terms.orderBy("idx").toLocalIterator()]
        return CountVectorizerModel(input=self.input, output=self.output, row_id=self.row_id, vocabulary=words, min_tf=self.min_tf, binary=self.binary)


def inverse_document_frequency(entries: DataFrame, n_docs: int, min_doc_freq: int = 0) -> DataFrame:
    """(idx, df, idf) from long entries (row_id, idx, value): ln((m + 1) / (df + 1)) over entries
    above 0, and 0 for rarer than ``min_doc_freq``."""
    df = entries.where("value > 0").groupBy("idx").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.when(F.col("df") >= min_doc_freq, F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1))).otherwise(0.0))


def tf_idf(entries: DataFrame, idf: DataFrame) -> DataFrame:
    """Long entries times their index's idf; the frequency table is a keyed join, of any length."""
    return entries.join(idf.select("idx", "idf"), "idx").select("row_id", "idx", (F.col("value") * F.col("idf")).alias("value"))


def corpus_dictionary(docs: DataFrame, text: str) -> DataFrame:
    """(word, word_id): dense ids of a corpus's words by the alphabet; words are split at white
    space, plus, bar and comma. Ids come from a range partitioning with an offset for each
    partition, so no single task orders the whole dictionary."""
    words = docs.select(F.explode(F.split(text, r"[\s+|,]")).alias("word")).where("word <> ''").distinct()
    return dense_ids(words, "word", "word_id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with 0-based ids in the order of a unique key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both uses below see the same partitions
    ordered = cut(df.repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "ids")
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return ordered.join(F.broadcast(starts), "__p").withColumn(name, (F.col("__start") + place).cast("long")).drop("__p", "__start")


def subsampling_probability(counts: DataFrame, rate: float = 1e-3) -> DataFrame:
    """(word, n, keep): the chance that an occurrence of a word is kept,
    (sqrt(z / rate) + 1) * rate / z for its share z of all words, 1 at most."""
    z = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("word", "n", F.least(F.lit(1.0), (F.sqrt(z / rate) + 1) * rate / z).alias("keep"))


def subsample(tokens: DataFrame, keep: DataFrame, seed: int = 42) -> DataFrame:
    """(row_id, pos, word) without the occurrences that chance, seeded by their place, leaves out."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "row_id", "pos", "word"), F.lit(1 << 53)) / float(1 << 53)).cast("double")
    return tokens.join(keep.select("word", "keep"), "word").where(u < F.col("keep")).select("row_id", "pos", "word")
