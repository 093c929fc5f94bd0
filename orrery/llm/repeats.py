"""Removal of repeated passages: distributed prefix doubling over content-defined positions.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier in the
corpus (smaller doc_id, or the same document and an earlier start). Prefix doubling ranks
positions by ever longer prefixes, pairing the rank of a position with the rank of a later one,
and leaves out positions whose rank is unique. Three things keep that affordable over whole corpora:

* ranks are names (64-bit hashes of bytes, or of the first place that has them) instead of dense ordinals;
* the first round (32 bytes) ranks anchors only. The anchor of a window of ``length`` bytes is its
  smallest 32-byte name, leftmost on ties, so equal windows have equal anchors at equal offsets,
  and a text has about one anchor for each 35 bytes. Anchors with a unique name drop out together
  with all windows that they stand for;
* an anchor's name is then paired with that of everything its windows cover. If all places
  of an anchor agree there, the first place is the original and all windows of the others are
  repeats; so are, where they differ, all but the first place of each such context. Only the windows of these
  first places are positions of the further rounds.

The further rounds double the prefix: 32 bytes with the 32 bytes at offset 32, 64 with those at offset 64,
and so on, and last the longest prefix with one of the same length that ends where the window ends. Each
round sorts the pairs (rank, rank at the offset), gives positions with equal pairs the number of their
first place as their new rank, and drops positions whose pair is unique. Equal windows share their anchor's
name, so Spark sorts these contexts by it and the rounds run over the names of a batch, on some
bytes for each window instead of a shuffled row; a name with over MAX_WINDOWS windows is ranked by the same
rounds over rows that Spark sorts.

Frequent passages never gather in one task: anchors are ranked by grouped minima and counts, combined
before their shuffle and written, and joins that adaptive execution can split; sorted pairs are split by their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import mix64, prefix_hash, span_hash
from orrery.plans.storage import cut, drop_cut, small_side, text_batches

FIRST = 32
#: Bytes of a text that are looked at together; longer texts go in overlapping pieces.
PIECE = 1 << 22
#: Columns of ``remove_repeats``.
MADE = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}
#: Rows of an outgoing Arrow batch, about.
FLUSH = 200_000
_LAST = 2**63 - 1
#: Repeated anchor names that go to the tasks as a sorted array (32 MB); more are joined.
FILTER_NAMES = 4_000_000
#: Windows of one anchor name that are ranked in one task (some 50 MB); names with more are ranked by Spark.
MAX_WINDOWS = 500_000
#: Windows of a range that one task ranks, about.
RANGE_ROWS = 250_000


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, context, first, last) of a text's anchors: their 32-byte names, the names of all that
    their windows cover, and the first and last start of these windows."""
    found = []
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[at : at + PIECE + length - 1]
        p = prefix_hash(part)
        i = np.arange(len(part) - FIRST + 1)
        name = span_hash(p, i, i + FIRST)
        key = (name & ~np.uint64(2**23 - 1)) | i.astype(np.uint64)
        width, have = length - FIRST + 1, 1
        low = key
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            rest = width - have
            low = np.minimum(low[: len(low) - rest], low[rest:])
        owner = (low & np.uint64(2**23 - 1)).astype(np.int64)
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        a = np.concatenate(([0], edge + 1))
        b = np.concatenate((edge, [len(owner) - 1]))
        q = owner[a]
        where = ((q - a) * 8192 + (b - a)).astype(np.uint64)
        context = mix64(span_hash(p, a, b + length) + mix64(where))
        found.append((name[q], context, a + at, b + at))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc (ids, those without one last), th (0; where ids repeat, the hash of the text, so that
    rows that share an id but not the text stay apart), text and row (all columns); and whether ids are unique."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    unique = docs.groupBy(doc.alias("d")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    th = F.lit(0).cast("long") if unique else F.xxhash64(text)
    return docs.select(doc.alias("doc"), th.alias("th"), text.cast("binary").alias("text"), F.struct(*[c for c in docs.columns if c not in MADE]).alias("row")), unique


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer() or b"", np.uint8)


def _flushed(batches, make, names, types):
    """Run ``make`` (text, row -> equally long arrays) over texts, in batches of bounded size."""
    held, size = [], 0

    def out():
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, types, strict=True)], names)

    for b in batches:
        texts = _column(b, "text")
        docs, hashes = (_column(b, c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
        for k in range(b.num_rows):
            got = make(_bytes(texts[k]), b, k)
            n = len(got[0])
            if n:
                held.append((np.full(n, docs[k]), np.full(n, hashes[k]), *got))
                size += n
            if size >= FLUSH:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _names(rows: DataFrame, length: int) -> DataFrame:
    """(k): the names of all anchors."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for t in _column(b, "text"):
                held.append(anchors(_bytes(t), length)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["k"])
                    held, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["k"])

    return rows.select("text").mapInArrow(run, "k long")


def _places(rows: DataFrame, often: DataFrame, length: int) -> DataFrame:
    """(doc, th, k, c, a, n) of the anchors whose name is in ``often``: name, context, the first
    window's start, and the number of windows. Up to FILTER_NAMES names go to the
    tasks as a sorted array (8 bytes each); more are joined."""
    spark = rows.sparkSession
    few = often.count() <= FILTER_NAMES
    known = None
    if few:
        got = often.toArrow().column(0).to_numpy()
        known = spark.sparkContext.broadcast(np.sort(got))

    def run(batches):
        names = known.value.view() if few else None

        def make(data, _, __):
            name, context, a, b = anchors(data, length)
            k = name.view(np.int64)
            if names is not None:
                at = np.minimum(np.searchsorted(names, k), max(len(names) - 1, 0))
                ok = names[at] == k if len(names) else np.zeros(len(k), bool)
                k, context, a, b = k[ok], context[ok], a[ok], b[ok]
            return k, context.view(np.int64), a, b - a + 1

        yield from _flushed(batches, make, ["doc", "th", "k", "c", "a", "n"], [np.int64] * 4 + [np.int32] * 2)

    made = rows.select("doc", "th", "text").mapInArrow(run, "doc long, th long, k long, c long, a int, n int")
    return made if few else made.join(often, "k", "left_semi").select("doc", "th", "k", "c", "a", "n")


def schedule(length: int) -> list[tuple[int, int]]:
    """The rounds after the first, as (offset, bytes ranked by the pair): doubled prefixes, then the whole window."""
    out, k = [], FIRST
    while k < length:
        offset = min(k, length - k)
        out.append((offset, offset + k))
        k += offset
    return out


def _listed(rows: DataFrame, places: DataFrame, unique: bool) -> DataFrame:
    """Texts of ``rows`` that have ``places`` (doc, th, k, a, n), with these in a column ``parts``."""
    parts = cut(places.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("a", "n", "k"))).alias("parts")), "parts")
    texts = rows if unique else rows.dropDuplicates(["doc", "th"])
    return texts.join(parts, ["doc", "th"])


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(k, doc, th, a, context): the bytes that the windows of a text's listed anchors cover."""
    names = ["k", "doc", "th", "a", "context"]

    def run(batches):
        held, size = [], 0

        def out():
            doc, th, k, a, pieces, ends = (np.concatenate(x) for x in zip(*held, strict=True))
            offsets = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
            context = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(pieces)])
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(doc), pa.array(th), pa.array(a), context], names)

        for b in batches:
            docs, hashes, parts = (_column(b, c) for c in ("doc", "th", "parts"))
            for i, t in enumerate(_column(b, "text")):
                data, v = _bytes(t), parts[i].values
                a, n, k = (v.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                ends = n.astype(np.int64) + length - 1
                at = np.repeat(a - np.concatenate(([0], np.cumsum(ends)[:-1])), ends) + np.arange(ends.sum())
                held.append((np.full(len(a), docs[i].as_py()), np.full(len(a), hashes[i].as_py()), k, a, data[at], ends))
                size += len(at)
                if size >= 8 * FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("doc", "th", "text", "parts").mapInArrow(run, "k long, doc long, th long, a int, context binary")


def later_windows(data: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Whether an earlier window equals a window, for the windows at starts[i] .. starts[i] + n[i] - 1 of
    ``data``, by the rounds of ``schedule``. The order of the windows is that of the places."""
    p = prefix_hash(data)
    pos = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    alive = np.arange(len(pos))
    rank = span_hash(p, pos, pos + FIRST)
    first = alive
    for offset, ranked in schedule(length):
        at = pos[alive]
        follows = span_hash(p, at + offset, at + ranked)
        order = np.lexsort((follows, rank))
        r, x = rank[order], follows[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
        of = np.cumsum(new) - 1
        alive, first = alive[order], alive[order][new][of]
        often = np.bincount(of)[of] > 1 if len(of) else new
        alive, first = alive[often], first[often]
        back = np.argsort(alive)
        alive, first = alive[back], first[back]
        rank = first
    out = np.zeros(len(pos), bool)
    out[alive[alive != first]] = True
    return out


def _later_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, th, s, e): runs of the windows in ``contexts`` that an earlier one equals."""

    def ranked(t: pa.Table) -> pa.RecordBatch:
        context = t.column("context").combine_chunks()
        context = context.chunk(0) if isinstance(context, pa.ChunkedArray) else context
        _, offsets, data = context.buffers()
        offsets = np.frombuffer(offsets, np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        starts, n = offsets[:-1] - offsets[0], np.diff(offsets) - length + 1
        later = later_windows(data, starts, n, length)
        owner = np.repeat(np.arange(len(n)), n)
        edge = np.ones(len(owner), bool)
        edge[1:] = owner[1:] != owner[:-1]
        begins = np.flatnonzero(later & (edge | ~np.concatenate(([False], later[:-1]))))
        ends = np.flatnonzero(later & np.concatenate((edge[1:] | ~later[1:], [True])))
        base = np.concatenate(([0], np.cumsum(n)[:-1]))
        doc, th, a = (t.column(c).to_numpy() for c in ("doc", "th", "a"))
        o = owner[begins]
        columns = (doc[o], th[o], (a[o] + begins - base[o]).astype(np.int32), (a[o] + ends - base[o] + length).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "th", "s", "e"])

    def run(batches):
        held, size = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            size += b.nbytes
            if size >= 8 * FLUSH:
                k = held.column("k").to_numpy()
                whole = int(np.searchsorted(k, k[-1]))
                if whole:
                    yield ranked(held.slice(0, whole))
                    held = held.slice(whole).combine_chunks()
                size = 0 if whole else size
        if held is not None and held.num_rows:
            yield ranked(held)

    dealt = contexts.repartition("k").sortWithinPartitions("k", "doc", "th", "a")
    return dealt.mapInArrow(run, "doc long, th long, s int, e int")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(doc, th, s, rank, next): the windows of a text's listed anchors, the name of their first FIRST
    bytes and, for each further round, the name of what stands at its offset (as many bytes as were
    ranked before)."""
    rounds = schedule(length)

    def run(batches):
        def make(data, batch, k):
            v = _column(batch, "parts")[k].values
            a, n = (v.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            s = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            s.sort()
            names = np.empty((1 + len(rounds), len(s)), np.uint64)
            for at in range(0, len(data), PIECE):
                lo, hi = np.searchsorted(s, (at, at + PIECE))
                if hi > lo:
                    p = prefix_hash(data[at : at + PIECE + length])
                    r = s[lo:hi] - at
                    names[0, lo:hi] = span_hash(p, r, r + FIRST)
                    for j, (offset, ranked) in enumerate(rounds, 1):
                        names[j, lo:hi] = span_hash(p, r + offset, r + ranked)
            return s, *names.view(np.int64)

        names = [f"n{j}" for j in range(1 + len(rounds))]
        yield from _flushed(batches, make, ["doc", "th", "s", *names], [np.int64, np.int64, np.int32] + [np.int64] * len(names))

    columns = ", ".join(f"n{j} long" for j in range(1 + len(rounds)))
    made = texts.select("doc", "th", "text", "parts").mapInArrow(run, f"doc long, th long, s int, {columns}")
    return made.select("doc", "th", "s", F.col("n0").alias("rank"), F.array(*[f"n{j}" for j in range(1, 1 + len(rounds))]).alias("next"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """(doc, th, s, rank, next, later) of the windows of ``pairs`` (rank, at, doc, th, s, next) whose (rank, at) isn't unique:
    the new rank is named by the first place of the pair, and ``later`` tells all other places.

    Spark sorts the pairs together with their places, so that even one very frequent pair is split over many ranges. A
    task ranks its range; what the ends of the ranges (a row for each) share is put right afterwards."""
    own = ["rank", "at", "doc", "th", "s"]
    ranges = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // RANGE_ROWS))

    def local(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        rank, at = t.column("rank").to_numpy(), t.column("at").to_numpy()
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (at[1:] != at[:-1])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        n = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        end = (start == 0) * 1 + (start == start[-1]) * 2
        for name, x in (("n", n), ("end", end.astype(np.int32)), ("part", np.full(len(rank), TaskContext.get().partitionId(), np.int32))):
            t = t.append_column(name, pa.array(x))
        for c in ("doc", "th", "s"):
            t = t.append_column(f"f_{c}", pa.array(t.column(c).to_numpy()[start]))
        yield from t.combine_chunks().to_batches(max_chunksize=FLUSH)

    dealt = pairs.select(*own, "next").repartitionByRange(ranges, *own).sortWithinPartitions(*own)
    schema = "rank long, at long, doc long, th long, s int, next array<long>, n long, end int, part int, f_doc long, f_th long, f_s int"
    ranked = cut(dealt.mapInArrow(local, schema), "ranked")
    pair, first = F.struct("rank", "at"), F.struct("f_doc", "f_th", "f_s")
    ends = ranked.where("end > 0").groupBy("part").agg(F.min(pair).alias("low"), F.max(pair).alias("high"), F.min(F.when(F.col("end") >= 2, first)).alias("first"))
    before, after, last, carried = {}, set(), None, None
    for r in ends.orderBy("part").toLocalIterator():  # a row for each range
        goes_on = last is not None and last.high == r.low
        if goes_on:
            before[r.part] = tuple(carried)
            after.add(last.part)
        carried = carried if goes_on and r.low == r.high else r.first
        last = r

    def joined(batches):
        for b in batches:
            n, end, part = (_column(b, c).to_numpy() for c in ("n", "end", "part"))
            f = [_column(b, c).to_numpy().copy() for c in ("f_doc", "f_th", "f_s")]
            keep = n > 1
            for p in np.unique(part[end > 0]):
                if int(p) in before:
                    rows = (part == p) & (end % 2 == 1)
                    keep |= rows
                    for x, value in zip(f, before[int(p)], strict=True):
                        x[rows] = value
                if int(p) in after:
                    keep |= (part == p) & (end >= 2)
            place = [_column(b, c).to_numpy() for c in ("doc", "th", "s")]
            later = np.logical_or.reduce([x != y for x, y in zip(place, f, strict=True)])
            columns = [_column(b, c) for c in ("doc", "th", "s", "next")] + [pa.array(x) for x in (*f, later)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "th", "s", "next", "f_doc", "f_th", "f_s", "later"]).filter(pa.array(keep))

    kept = ranked.mapInArrow(joined, "doc long, th long, s int, next array<long>, f_doc long, f_th long, f_s int, later boolean")
    return kept.select("doc", "th", "s", F.xxhash64("f_doc", "f_th", "f_s").alias("rank"), "next", "later")


def _doubled(windows: DataFrame, length: int) -> DataFrame:
    """(doc, th, s): of ``windows`` (see ``_windows``) those that an earlier one equals. One round for each
    doubling: pairs of ranks are sorted, positions ranked anew by the first place of their pair, and those of a
    unique pair dropped."""
    windows = cut(windows, "windows")
    for j, _ in enumerate(schedule(length)):
        kept = cut(_ranked(windows.withColumn("at", F.get("next", j))), "windows")
        drop_cut(windows)
        windows = kept
    return windows.where("later").select("doc", "th", "s")


def repeated_spans(rows: DataFrame, length: int, unique: bool) -> DataFrame:
    """(doc, th, spans): for each text with repeats, the byte ranges [s, e) that start-earlier
    strings cover; ranges may overlap. ``rows``: doc, th, text; ``unique``: whether doc is."""
    often = cut(_names(rows, length).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "names")
    places = cut(_places(rows, often, length), "places")
    drop_cut(often)
    place = F.struct("doc", "th", "a")
    # each round's grouped table is written, so that the join after it stands on plain exchanges and hot names can be split
    keys = cut(places.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(place).alias("f")), "keys")
    judged = places.join(keys, "k").where("c0 <> c1 or struct(doc, th, a) <> f")
    judged = cut(judged.select("doc", "th", "k", "c", "a", "n", (F.col("c0") != F.col("c1")).alias("differs")), "judged")
    drop_cut(places, keys)
    differing = judged.where("differs")
    classes = cut(differing.groupBy("k", "c").agg(F.min(place).alias("f")), "classes")
    split = differing.join(classes, ["k", "c"]).select("doc", "th", "k", "a", "n", F.expr("struct(doc, th, a) = f").alias("first"))
    split = cut(split, "split")
    drop_cut(classes)
    # rows equal in id and text have equal places: one of them is enough
    positions = split.where("first") if unique else split.where("first").distinct()
    hot = cut(positions.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > MAX_WINDOWS).select("k"), "hot")
    many = small_side(hot)
    contexts = cut(_contexts(_listed(rows, positions.join(many, "k", "left_anti"), unique), length), "contexts")
    found = cut(_later_windows(contexts, length), "found")
    drop_cut(contexts)
    if not hot.isEmpty():
        windows = _windows(_listed(rows, positions.join(many, "k", "left_semi"), unique), length)
        found = found.union(_doubled(windows, length).select("doc", "th", "s", (F.col("s") + length).alias("e")))
    whole = judged.where("not differs").select("doc", "th", "a", "n").union(split.where("not first").select("doc", "th", "a", "n"))
    whole = whole.select("doc", "th", F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + length).alias("e"))
    spans = cut(whole.union(found).groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    drop_cut(judged, split, hot)
    return spans


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, further columns kept) with n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes; they may cut a character in two).

    Null texts count as empty. Texts shorter than ``length`` bytes lose nothing and give nothing
    away. Columns named as the new ones are replaced. Rows without a doc_id come after all others. Rows that share a doc_id but not the text
    stand in the order of their texts' hashes; rows that share both are one document, and each
    returns its result. An empty table gives no rows. ``length`` is at least 64.
    """
    if not 2 * FIRST <= length < 4096:
        raise ValueError("length must be from 64 to 4095")
    text_batches(docs.sparkSession)
    rows, unique = _keyed(docs)
    spans = repeated_spans(rows.select("doc", "th", "text"), length, unique)
    joined = rows.join(spans, ["doc", "th"], "left").select("text", "spans", "row")
    made = ", ".join(f"{k} {v}" for k, v in MADE.items())

    def run(batches):
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            spans_of = _column(b, "spans")
            for k, t in enumerate(_column(b, "text")):
                data = _bytes(t)
                size.append(len(data))
                if not spans_of[k].is_valid:
                    gone.append(0)
                    runs.append(0)
                    kept.append(data.tobytes())
                    continue
                v = spans_of[k].values
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, v.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, v.field(1).to_numpy(zero_copy_only=False), -1)
                out = np.cumsum(edge[:-1]) > 0
                gone.append(int(out.sum()))
                runs.append(int((out[1:] & ~out[:-1]).sum()) + int(out[0]))
                kept.append(data[~out].tobytes())
            new = [pa.array(x, pa.int64()) for x in (size, gone, runs)] + [pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([_column(b, "row"), *new], ["row", *MADE])

    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, {made}")
    return out.select("row.*", *MADE)
