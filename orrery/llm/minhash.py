"""Near-duplicate detection with SetSketch registers.

Each text's set of distinct 5-word shingles gets a sketch of M registers. A register is the
truncated exponent floor(1 - log_b(h)) of the smallest of the set's exponentially distributed
hash values (Ertl's SetSketch): the sketch of a union is the register-wise maximum, and two
registers agree with a probability of at least the Jaccard similarity. Registers are cut into
bands; texts that share a band are candidates. For a candidate pair the numbers of larger, smaller
and equal registers give the likelihood of every similarity, and pairs for which all similarities
from the threshold up are implausible are left out; the others are confirmed on the full sets.

With 32 bands of 4 registers a pair at similarity 0.75 shares no band with a probability of 5e-6,
at 0.8 of 5e-8.

Groups of copies never become pairs. Texts with equal sets are one class with its smallest doc_id
for a representative. In a band's bucket, members are compared with its smallest one, the centre;
links to centres join most of a group of near copies. Buckets that then still hold several
components are mostly texts that share a passage. Their members get a second, finer sketch of
fresh hash functions (110 bands of 8 registers, under which a pair at 0.75 shares no band with a
probability of 1e-5, one at 0.4 shares one with 0.07). Members that share a finer band but no
component are looked up in inverted indexes of their families, on full sets, without listing
pairs. So each link between different texts is either found or implied by links that connect the
same documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import connected_components
from orrery.llm.text import mix64, shingle_set
from orrery.plans.storage import cut, small_side, text_batches

BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Bands for texts whose bucket holds several components after the comparison with its centre.
FINE_BANDS, FINE_ROWS = 110, 8
#: Shingles of an inverted index in which such texts are looked up, about, and of the texts that one task
#: looks up in it.
BLOCK_SHINGLES = 1 << 16
#: SetSketch parameters: base, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65534
_rng = np.random.Generator(np.random.PCG64(4))


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**64, n, dtype=np.uint64)


COARSE, FINE = _hash_family(M), _hash_family(FINE_BANDS * FINE_ROWS)
#: A pair is left out unverified if the best similarity at or above the threshold is e**20 times
#: less likely than the best of all.
LOG_ODDS = 20.0


def registers(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray] = COARSE) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes: an unsigned 16-bit register for each hash function."""
    times, flips = family
    low = np.full(len(times), 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = ((shingles[i : i + 1024, None] ^ flips) * times) >> np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype("<u2")


def log_likelihoods(n_u, n_v, greater, less, similarity: np.ndarray) -> np.ndarray:
    """Joint log-likelihood (pairs x similarities) of the numbers of registers of u that are
    greater and less than v's, given the two set sizes."""
    n_u, n_v, greater, less = (np.asarray(x, np.float64)[:, None] for x in (n_u, n_v, greater, less))
    u = n_u / (n_u + n_v)
    j = np.minimum(similarity[None, :], np.minimum(n_u, n_v) / np.maximum(n_u, n_v))

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    above, below = p(u - (1 - u) * j), p((1 - u) - u * j)
    tiny = 1e-12
    return (
        greater * np.log(np.maximum(above, tiny))
        + less * np.log(np.maximum(below, tiny))
        + (M - greater - less) * np.log(np.maximum(1 - above - below, tiny))
    )


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()):
        yield x.as_py() or b""


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two order-free sums and its size, mixed."""
    from hashlib import blake2b

    raw = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, k1, k2, regs): set size, 128-bit name of the set, packed registers."""

    def run(batches):
        for b in batches:
            rows = []
            for text in _texts(b):
                s = shingle_set(text, n)
                rows.append((len(s), *_set_key(s), registers(s).tobytes() if len(s) else None))
            size, k1, k2, regs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("text_hash"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "k1", "k2", "regs"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, regs binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, k1, set) of the wanted (rep, k1): sorted 64-bit hashes as bytes."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([_set_key(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["rep", "k", "set"],
            )

    ids = small_side(wanted.select("rep").distinct())
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == ids.rep, "left_semi")
    found = rows.mapInArrow(run, "rep long, k long, set binary").dropDuplicates(["rep", "k"])
    return found.withColumnRenamed("k", "k1")


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, ka, b, kb) that the joint likelihood of their registers doesn't rule out."""
    grid = np.unique(np.append(np.linspace(0, 1, 101), threshold))
    side = reps.select("rep", "k1", "n_shingles", "regs")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
            ll = log_likelihoods(na, nb, (ra > rb).sum(1), (ra < rb).sum(1), grid)
            possible = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * round(100 * threshold)
            ok = possible & (ll[:, grid >= threshold].max(1) >= ll.max(1) - LOG_ODDS)
            yield b.filter(pa.array(ok)).select(["a", "ka", "b", "kb"])

    return (
        pairs.join(side.toDF("a", "ka", "na", "ra"), ["a", "ka"])
        .join(side.toDF("b", "kb", "nb", "rb"), ["b", "kb"])
        .select("a", "ka", "b", "kb", "na", "nb", "ra", "rb")
        .mapInArrow(run, "a long, ka long, b long, kb long")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) among pairs: 100 * intersection >= 100 * threshold * union on the full sets."""
    percent = round(100 * threshold)

    def run(batches):
        last, known = None, None
        for b in batches:
            out = []
            for a, sa, c, sc in zip(*(b.column(x) for x in ("a", "sa", "b", "sb")), strict=True):
                raw = sc.as_buffer()
                if last is None or raw != last:
                    last, known = raw, np.frombuffer(raw, np.uint64)
                mine = np.frombuffer(sa.as_buffer(), np.uint64)
                at = np.searchsorted(known, mine)
                both = int((known[np.minimum(at, len(known) - 1)] == mine).sum())
                if 100 * both >= percent * (len(mine) + len(known) - both):
                    out.append((a.as_py(), c.as_py()))
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return (
        pairs.join(sets.toDF("a", "ka", "sa"), ["a", "ka"])
        .join(sets.toDF("b", "kb", "sb"), ["b", "kb"])
        .select("a", "sa", "b", "sb")
        .mapInArrow(run, "u long, v long")
    )


def _fine_links(labelled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between members of different labels in ``labelled`` (bucket, rep, k1, n_shingles,
    label; the buckets that hold several labels).

    Texts that share a finer band with texts of another label look for links in blocks. A block
    holds texts whose largest bucket is the same, so a family of near copies or of texts
    around one passage is met as a whole; a large family makes several blocks, and the texts that look for links in it
    take several turns at each. A task holds a block as an inverted index of about BLOCK_SHINGLES shingles and looks up texts of
    about as many, however large the family is; only links leave it: no pairs are listed.
    """
    percent = round(100 * threshold)
    sizes = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = labelled.join(sizes, "bucket").groupBy("rep", "k1", "label").agg(F.max(F.struct("n", "bucket", "s")).alias("top"))
    parts = F.ceil(F.col("top.s") / BLOCK_SHINGLES).cast("int")
    texts = largest.select("rep", "k1", "label", F.col("top.bucket").alias("family"), parts.alias("parts"))
    texts = cut(texts.join(sets, ["rep", "k1"]), "texts")

    own = ["rep", "k1", "label", "family", "parts"]

    def sketch(batches):
        for b in batches:
            regs = [registers(np.frombuffer(x.as_buffer(), np.uint64), FINE) for x in b.column(5)]
            keys = [np.frombuffer(r.tobytes(), f"S{2 * FINE_ROWS}") for r in regs]
            halves = [np.frombuffer(k.tobytes(), "<u8").reshape(-1, 2 * FINE_ROWS // 8) for k in keys]
            bands = np.arange(FINE_BANDS, dtype=np.uint64)
            named = []
            for h in halves:
                x = mix64(bands + np.uint64(1))
                for column in h.T:
                    x = mix64(x ^ column)
                named.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(named, pa.list_(pa.int64()))], [*own, "bands"])

    banded = texts.select(*own, "set").mapInArrow(sketch, "rep long, k1 long, label long, family long, parts int, bands array<long>")
    bands = cut(banded.select(*own, F.explode("bands").alias("band")), "fine")
    sizes = bands.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed = bands.join(main.select("band", F.col("top.label").alias("main")), "band")
    # the bands of a text mostly lead to the same few families
    there = mixed.groupBy("band").agg(F.array_sort(F.collect_set(F.struct("family", "parts"))).alias("families"))
    asked = mixed.where("label <> main").select("band", "rep", "k1", "label").join(there, "band")
    asked = asked.select("rep", "k1", "label", "families").distinct().select("rep", "k1", "label", F.explode("families").alias("f"))
    asked = cut(asked.select("rep", "k1", "label", "f.family", "f.parts").distinct().join(sets, ["rep", "k1"]), "asked")
    turns = F.ceil(F.sum(F.length("set")) / (8 * BLOCK_SHINGLES)).cast("int")
    turns = small_side(cut(asked.groupBy("family").agg(turns.alias("turns")), "turns"))
    dealt_by = lambda n, salt: F.pmod(F.xxhash64("rep", "k1", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = texts.join(turns, "family").withColumn("part", dealt_by("parts", 0)).withColumn("turn", each("turns"))
    asks = asked.join(turns, "family").withColumn("turn", dealt_by("turns", 1)).withColumn("part", each("parts"))
    columns = [F.xxhash64("family", "part", "turn").alias("block"), "rep", "label", "set"]
    dealt = held.select(F.lit(0).alias("kind"), *columns).union(asks.select(F.lit(1).alias("kind"), *columns))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "kind")

    def look_up(batches):
        block, index = None, None
        ids, labels, found = [], [], []
        for b in batches:
            out = []
            for kind, at, rep, label, raw in zip(*(b.column(c).to_pylist() for c in ("kind", "block", "rep", "label", "set")), strict=True):
                if at != block:
                    block, index, ids, labels, found = at, None, [], [], []
                mine = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    ids.append(rep)
                    labels.append(label)
                    found.append(mine)
                    continue
                if index is None and not found:
                    continue
                if index is None:
                    size = np.array([len(x) for x in found])
                    owner = np.repeat(np.arange(len(found)), size)
                    every = np.concatenate(found)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], size, np.array(labels), np.array(ids)
                keys, owner, size, label_of, id_of = index
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                n = hi - lo
                at_all = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at_all], minlength=len(size))
                linked = (100 * both >= percent * (len(mine) + size - both)) & (label_of != label)
                # one link to each other component is enough
                _, first = np.unique(label_of[linked], return_index=True)
                out.extend((rep, int(v)) for v in id_of[linked][first])
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return cut(dealt.mapInArrow(look_up, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, n: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, more columns ignored): doc_id, n_shingles,
    component_id (smallest doc_id reachable over links of at least ``threshold``), kept, and
    text_hash (xxhash64 of the text, which tells rows that repeat a doc_id apart).

    Null or empty texts and texts without words have an empty set: n_shingles 0, linked with
    nothing, kept. Rows without a doc_id can't be named: component_id null, kept, linked with
    nothing. Rows that repeat a doc_id are the same document for links; each row gets the
    component of its own text. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    made = cut(sketches(docs, n), "sketch")
    named = made.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = cut(
        named.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"])
        .select(F.col("doc_id").alias("rep"), "k1", "k2", "n_shingles", "regs")
        .dropDuplicates(["k1", "k2"]),
        "reps",
    )
    width = 2 * ROWS
    bands = reps.select(
        "rep",
        "k1",
        "n_shingles",
        F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {width} + 1, {width})))")).alias("bucket"),
    )
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(bands.join(shared, "bucket"), "members")
    sets = cut(_full_sets(docs, members.select("rep", "k1").distinct(), n), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b or ka <> kb").distinct()
        return cut(_confirmed(_plausible(pairs, reps, threshold), sets, threshold), "links")

    # written, so that the join stands on plain exchanges and a large bucket can be split
    centre = cut(members.groupBy("bucket").agg(F.min(F.struct("rep", "k1")).alias("c")), "centres")
    to_centre = members.join(centre.select("bucket", F.col("c.rep").alias("b"), F.col("c.k1").alias("kb")), "bucket").select(
        F.col("rep").alias("a"), F.col("k1").alias("ka"), "b", "kb"
    )
    comps = cut(connected_components(links_of(to_centre)), "components")
    labelled = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "k1", "n_shingles", F.coalesce("component", "rep").alias("label"))
    unsure = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    again = cut(labelled.join(unsure, "bucket", "left_semi"), "unsure")
    more = _fine_links(again, sets, threshold)
    if not more.isEmpty():
        # the new links join whole components
        label = again.select("rep", "label").distinct()
        between = more.join(label.toDF("u", "lu"), "u").join(label.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        joined = connected_components(between).toDF("label", "lowest")
        every = reps.select("rep").distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("rep").alias("node"), F.coalesce("component", "rep").alias("label"))
        comps = every.join(joined, "label", "left").select("node", F.coalesce("lowest", "label").alias("component"))
    named_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component_id")
    )
    result = made.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(named_class, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")
