"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A bin carries a bitmap of the sources and one of the duplicate clusters that it already holds; an
item fits if the room suffices and neither bitmap has its bit. Open bins stand in the order of
their remaining room. For an item the search starts at the successor of its size, the tightest bin
with room, and goes on upward until a bin is compatible; without one it opens a new bin. Items come
by falling size, so the result is a best-fit-decreasing packing.

Texts longer than a bin are cut into pieces of a full bin and a rest. Documents are dealt to shards
of bounded size by a hash, so a hot source or a cluster of thousands of copies is spread evenly;
each shard is packed on its own.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import word_count
from orrery.plans.storage import cut

#: Items of a shard, about; the last bins of a shard are the only ones that wait for more items.
SHARD_ITEMS = 4096
#: Stands for a missing doc_id while rows are in pandas, which would turn ids with gaps into floats.
_LAST = 2**63 - 1


def pack_shard(size: np.ndarray, source: list, cluster: list, capacity: int, source_limit: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order. ``source_limit`` None leaves sources
    out of the conflicts; null sources and clusters never conflict."""
    bits: dict = {}
    for s in source:
        if s is not None and s not in bits:
            bits[s] = 1 << len(bits)
    often: dict = {}
    for c in cluster:
        if c is not None:
            often[c] = often.get(c, 0) + 1
    cluster_bits = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    room_order: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    bin_of, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for i, n in enumerate(size.tolist()):
        s = bits.get(source[i], 0) if source_limit else 0
        c = cluster_bits.get(cluster[i], 0)
        k, found = successor(room_order, n), None
        while k < len(room_order):
            b = room_order[k][1]
            if not (source_map[b] & s or cluster_map[b] & c):
                found = k
                break
            k += 1
        if found is None:
            b, room = len(source_map), capacity
            source_map.append(0)
            cluster_map.append(0)
        else:
            room, b = room_order.pop(found)
        source_map[b] |= s
        cluster_map[b] |= c
        bin_of[i], offset[i] = b, capacity - room
        if room > n:
            insort(room_order, (room - n, b))
    return bin_of, offset


def successor(room_order: list[tuple[int, int]], size: int) -> int:
    """Index of the first open bin with at least ``size`` room."""
    from bisect import bisect_left

    return bisect_left(room_order, (size, -1))


def pack(docs: DataFrame, capacity: int = 2048, cluster: Column | None = None, distinct_sources: bool = True, seed: int = 8) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source): doc_id, piece (0.. of a document), size (words),
    shard, bin (within the shard) and offset (first word's place in the bin), a row for each piece.

    ``cluster`` names duplicate clusters, by default equal texts. Two items of one bin never share
    a cluster, nor a source if ``distinct_sources``; rows without a source never conflict by it.
    Texts without words (null, empty) are one piece of size 0. Repeated rows and rows without a
    doc_id are documents of their own. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.md5(text) if cluster is None else cluster
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "source", word_count(F.col("text")).alias("words"), key.alias("cluster"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("long"))
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity))
    # written, so that its rows can be counted: one very long text makes many
    rows = cut(rows.drop("words"), "pieces")
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "cluster", "source", "piece"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        none = lambda c: [None if pd.isna(x) else x for x in c]
        bins, offset = pack_shard(pdf["size"].to_numpy(), none(pdf.source), none(pdf.cluster), capacity, 1 if distinct_sources else None)
        return pdf.assign(bin=bins, offset=offset)

    schema = "doc_id long, named boolean, piece long, size long, source string, cluster string, shard long, bin long, offset long"
    rows = rows.select("doc_id", "named", "piece", "size", F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"), "shard")
    packed = rows.groupBy("shard").applyInPandas(run, schema)
    return packed.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "piece", "size", "source", "cluster", "shard", "bin", "offset")
