"""From raw documents to packed training bins: toxicity, near duplicates, repeated passages, source
mix, packing. Each stage reads what its predecessor kept and wrote.

A stage takes (spark, docs, sf_dir). ``docs`` has the columns of the documents table (doc_id, text,
lang, source, n_chars); all stages but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import minhash, mixing, packing, repeats, toxicity
from orrery.plans.storage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, scored by a model of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates. Of rows that repeat doc_id
    and text one stays, the first by its other columns; rows without a doc_id all stay."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    own = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    named = own.where("doc_id is not null").join(kept, ["doc_id", "text_hash"], "left_semi")
    unique = named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not unique:
        named = named.groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "r.*")
    return named.select(*COLUMNS).union(own.where("doc_id is null").select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occur earlier; characters that a cut divides
    are left out, and so are documents of which nothing remains."""
    cleaned = repeats.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.try_validate_utf8(F.col("kept").cast("string")))
    whole = F.coalesce(text, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    cleaned = cleaned.withColumn("text", F.when(F.col("text").isNotNull(), whole)).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.where("n_removed = 0 or text <> ''").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, its text cut after the
    last word that the mix takes, in shards with shuffled order."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep_rows=True)
    takes = mixed.select(*COLUMNS, "size", F.explode("takes").alias("t"))
    pieces = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("t.words").cast("int")), "")
    text = F.when(F.col("t.words") == F.col("size"), F.col("text")).otherwise(part)
    rows = takes.select("doc_id", text.alias("text"), "lang", "source", F.col("t.shard").alias("shard"), F.col("t.place").alias("place"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 words, no two of a source or of equal texts in one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The learned toxicity model has no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
