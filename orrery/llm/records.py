"""Token ids in length-delimited binary record files.

File format (little-endian). A data file ``part-NNNNN.rec`` is a sequence of frames:

    u64 payload length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload

and a payload is ``i64 doc_id | u8 flags | ids``; flag 1: the document has no id, flag 2: the ids
are u32 instead of u16. The offset index ``part-NNNNN.idx`` holds a u64 frame offset for each
record, so that records can be read in any order without a scan. A masked checksum is
((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32, so that data which embeds its own checksums
doesn't weaken them.

Parts are ranges of doc_id in ascending order. A task writes its part under a name of its own
attempt and renames it when complete: a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from orrery.plans.storage import fresh_path, text_batches

MASK_DELTA = 0xA282EAD8
#: Words whose ids a Python worker remembers, at most; those not met for long are forgotten first.
CACHED_WORDS = 900_000
_NO_ID, _WIDE = 1, 2


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def frames(source) -> Iterator[bytes]:
    """Payloads of an open data file, both checksums of each verified."""
    while head := source.read(12):
        if len(head) < 12:
            raise ValueError("cut short in a header")
        size, crc = struct.unpack("<QI", head)
        if masked_crc(head[:8]) != crc:
            raise ValueError("wrong checksum of a length")
        body = source.read(size + 4)
        if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("wrong checksum of a payload")
        yield body[:size]


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (doc_id is None) * _NO_ID + wide * _WIDE
    return struct.pack("<qB", doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", data)
    ids = np.frombuffer(data, "<u4" if flags & _WIDE else "<u2", offset=9)
    return (None if flags & _NO_ID else doc_id), ids.astype("<u4")


def read_at(source, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset in the index."""
    source.seek(offset)
    return parse(next(frames(source)))


# The settings of a tokenizer file under which texts may be cut at blanks and line ends.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordEncoder:
    """Ids of texts by the tokenizer of a file, each distinct word encoded once and remembered.

    That holds for tokenizers that lower-case, drop white space and split at the borders between letters and
    other characters, which is read from their settings: no token then spans a blank or a line end. Words of letters only are single
    pieces and go to the tokenizer's model as such (with their bytes in its byte alphabet); all
    other words take the tokenizer's whole way, and so do whole texts under any other tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known = _Known(self, {})
        self.ends = {c: self._whole([c])[0] for c in ".,"}
        settings = json.loads(self.tokenizer.to_str())
        plain_parts = settings["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        self.apart = settings["normalizer"] == _NORMALIZER and plain_parts and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in settings["added_tokens"])
        # the short way is open only if it gives what the whole way gives
        probe = ["the", "Word", "Über", "éèñß", "x"]
        self.short = self.apart and all(self._piece(w) == ids for w, ids in zip(probe, self._whole(probe), strict=True))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _piece(self, word: str) -> bytes | None:
        """Ids of a word of letters, None for others."""
        low = word.lower()
        if not (word.isalpha() and low.isalpha()):
            return None
        if not low.isascii():
            if "\u03a3" in word or not unicodedata.is_normalized("NFC", word):
                return None
            low = low.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(low)]).tobytes()

    def ids_of(self, word: str) -> bytes:
        """Ids of one word."""
        ids = None
        if self.short:
            end = self.ends.get(word[-1:])
            if end is None:
                ids = self._piece(word)
            else:
                ids = self._piece(word[:-1])
                ids = ids and ids + end
        if ids is None:
            ids = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for t in texts:
            if not self.apart:
                yield np.frombuffer(self._whole([t or ""])[0], self.kind)
                continue
            if len(self.known) > CACHED_WORDS // 2:
                self.known = _Known(self, dict(self.known))
            words = (t or "").replace("\n", " ").split(" ")
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.kind)


class _Known(dict):
    """Ids of the words met lately; words met before that are taken over from ``older``."""

    def __init__(self, encoder: WordEncoder, older: dict[str, bytes]) -> None:
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.ids_of(word)
        self[word] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def encode(texts: Iterable[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of whole texts, with one encoder for each process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path].encode(texts)


def write_records(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order below ``out``.
    Returns the table of parts: part, path, n_docs, n_ids. Documents without an id come first,
    null texts count as empty, repeated ids stand in the order of their texts."""
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
        store.create_dir(root, recursive=True)
        own = f"{root}/part-{part:05d}.{uuid.uuid4().hex}"
        n_docs = n_ids = at = 0
        with store.open_output_stream(f"{own}.rec") as data, store.open_output_stream(f"{own}.idx") as index:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    some = b.slice(k, 256)
                    ids_of = encode(some.column(1).to_pylist(), tokenizer_path)
                    for doc_id, ids in zip(some.column(0).to_pylist(), ids_of, strict=True):
                        ids = np.append(ids, np.array(end_id, ids.dtype))
                        record = frame(payload(doc_id, ids))
                        data.write(record)
                        index.write(struct.pack("<Q", at))
                        at += len(record)
                        n_docs += 1
                        n_ids += len(ids)
        if not n_docs:
            store.delete_file(f"{own}.rec")
            store.delete_file(f"{own}.idx")
            return
        for kind in ("idx", "rec"):
            store.move(f"{own}.{kind}", f"{root}/part-{part:05d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{out}/part-{part:05d}.rec"], "n_docs": [n_docs], "n_ids": [n_ids]})

    made = ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long")
    listing = f"{out}/parts.parquet"
    made.write.mode("overwrite").parquet(listing)
    return spark.read.schema(made.schema).parquet(listing)


def read_records(parts: DataFrame) -> DataFrame:
    """Read part files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (unsigned crc32 of the ids as little-endian u32)."""
    # one row for each part file: a window over them is small, whatever the corpus
    before = F.sum("n_ids").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))
    listed = parts.select("path", F.coalesce(before, F.lit(0)).alias("base"), "part")
    n = max(parts.count(), 1)

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                rows = []
                with store.open_input_stream(name) as source:
                    for body in frames(source):
                        doc_id, ids = parse(body)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                        base += len(ids)
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return listed.repartitionByRange(n, "part").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def token_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` and read the files back; ``out`` defaults to the shared folder."""
    return read_records(write_records(docs, tokenizer_path, out or fresh_path(spark, "records"), end_id))
