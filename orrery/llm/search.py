"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is summed up at several resolutions: for 1, 2, 4, ... segments the mean and the deviation
of each segment. For two vectors, segment by segment,

    |x - y|^2 >= length * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2),

a lower bound of the distance that grows tighter from coarse to fine; with the norms it is an upper
bound of the inner product, <x, y> = (|x|^2 + |y|^2 - |x - y|^2) / 2. A block of queries meets block
after block of candidates; those whose bound stays below the k-th best score so far drop out level
by level, and only survivors get exact scores.

Queries are dealt into blocks and candidates into ranges of bounded size, and each block meets each range in a group of
its own, chunk by chunk: the number of groups grows with queries and candidates, and a task holds one query
block, one chunk and the k best of each query. The best of all ranges are merged in a second step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.plans.storage import cut, text_batches

#: Queries of a block and candidates of a chunk, about.
QUERY_BLOCK, CHUNK = 512, 2048
#: Candidates of a range, about, and ranges at most: each gives k rows for each query to the merge.
RANGE_ROWS, MAX_RANGES = 8192, 1024
#: Segments of the resolutions, coarse to fine; resolutions finer than the vectors are left out.
SEGMENTS = (1, 2, 4, 8, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each vector's segments, times the root of the segment's length:
    the bound is then a plain distance between these rows."""
    parts = np.array_split(x, segments, axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.hstack(
        [np.stack([p.mean(1) * r for p, r in zip(parts, root, strict=True)], 1), np.stack([p.std(1) * r for p, r in zip(parts, root, strict=True)], 1)]
    )


def _levels(width: int) -> list[int]:
    return [s for s in SEGMENTS if s * 2 <= width]


class Block:
    """Vectors with their ids, row numbers, norms and statistics."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.rows, self.x = ids, rows, x
        self.norm = (x * x).sum(1)
        self.stats = [statistics(x, s) for s in _levels(x.shape[1])]


class Best:
    """The k best (score, smaller id first) of each query of a block."""

    def __init__(self, queries: Block, k: int) -> None:
        self.q, self.k = queries, k
        self.score: list[np.ndarray] = [np.empty(0, np.int64) for _ in queries.ids]
        self.ids: list[np.ndarray] = [np.empty(0, np.int64) for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def offer(self, c: Block) -> int:
        """Take a chunk of candidates in; returns how many exact scores were needed."""
        q = self.q
        alive = q.rows[:, None] != c.rows[None, :]
        slack = 1e-9 * (q.norm[:, None] + c.norm[None, :] + 1)
        half = (q.norm[:, None] + c.norm[None, :]) / 2 + slack
        floor = self.least[:, None]
        if np.isfinite(self.least).all():
            for a, b in zip(q.stats, c.stats, strict=True):
                near = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]) / 2 - a @ b.T
                alive &= half - near >= floor
                if not alive.any():
                    return 0
        rows, columns = np.nonzero(alive)
        if len(rows) * 4 > alive.size:
            exact = np.rint(q.x @ c.x.T).astype(np.int64)[rows, columns]
        else:
            exact = np.rint(np.einsum("ij,ij->i", q.x[rows], c.x[columns])).astype(np.int64)
        good = exact >= self.least[rows]
        rows, columns, exact = rows[good], columns[good], exact[good]
        cut = np.searchsorted(rows, np.arange(len(q.ids) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            part = slice(cut[i], cut[i + 1])
            score = np.concatenate((self.score[i], exact[part]))
            ids = np.concatenate((self.ids[i], c.ids[columns[part]]))
            order = np.lexsort((ids, -score))[: self.k]
            self.score[i], self.ids[i] = score[order], ids[order]
            if len(order) == self.k:
                self.least[i] = score[order[-1]]
        return int(alive.sum())

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.score]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.q.rows, n)),
                pa.array(np.repeat(self.q.ids, n)),
                pa.array(np.concatenate(self.ids or [np.empty(0)]).astype(np.int64)),
                pa.array(np.concatenate(self.score or [np.empty(0)]).astype(np.int64)),
            ],
            ["row", "query_id", "vec_id", "score"],
        )


def quantized(rows: DataFrame, column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * component) as whole doubles; rows without an id, with a null
    vector, or with null or non-finite components are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(x, fine)
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    for i, part in enumerate(np.split(flat, np.cumsum(n)[:-1])):
        out[i, : len(part)] = part
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """Each query's k candidates of the highest integer inner product: query_id, rank (from 1),
    vec_id, score. ``vectors``: (vec_id, v) with whole components below 2**20 in size.

    Ties go to the smaller vec_id. Only a query's own row is no candidate of it: rows that repeat its
    id or vector are. Repeated query rows each get their rows. Shorter vectors
    count as if filled with zeros. Fewer than k candidates give fewer rows, an empty table none.
    """
    text_batches(vectors.sparkSession)
    # written with its row numbers, which would otherwise differ from one use to the next
    table = cut(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    shape = table.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    width, blocks = max(shape.width or 1, 1), max(1, -(-shape.asks // QUERY_BLOCK))
    ranges = min(max(1, -(-shape.n // RANGE_ROWS)), MAX_RANGES)
    chunks = max(1, -(-shape.n // (ranges * CHUNK)))
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    packed = F.collect_list(F.struct("vec_id", "row", "v")).alias("items")
    queries = table.where("asks").groupBy(number(1, blocks).alias("block")).agg(packed).select("block", every(ranges).alias("range"), F.lit(-1).cast("long").alias("chunk"), "items")
    candidates = table.groupBy(number(2, ranges).alias("range"), number(3, chunks).alias("chunk")).agg(packed)
    candidates = candidates.select(every(blocks).alias("block"), "range", "chunk", "items")
    tasks = min(blocks * ranges, 65_536)
    dealt = queries.union(candidates).repartition(tasks, "block", "range").sortWithinPartitions("block", "range", "chunk")

    def run(batches):
        best, at = None, None
        for b in batches:
            for block, part, chunk, items in zip(*(b.column(i) for i in range(4)), strict=True):
                v = items.values
                made = Block(v.field(0).to_numpy(), v.field(1).to_numpy(), _vectors(v.field(2), width))
                if chunk.as_py() < 0:
                    if best is not None:
                        yield best.rows()
                    best, at = Best(made, k), (block.as_py(), part.as_py())
                elif best is not None and at == (block.as_py(), part.as_py()):
                    best.offer(made)
        if best is not None:
            yield best.rows()

    found = dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
