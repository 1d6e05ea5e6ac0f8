"""Nearest neighbours by a block matrix join.

Queries are dealt into groups of bounded size and candidates into groups, too; a task has one of each. It keeps the blocks of its
queries and streams its candidates past them, so a vector reaches Python once for each group that it meets, not for each block.
Vectors are rounded to int8, each with its own scale and the exact length of its rounding error. A tile of integer products gives
all distances of two blocks, wrong by no more than the two errors. Only pairs that the bounds leave open are computed again in
double precision, from the vectors as they are, and merged by a heap for each query. Exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 2048, 256
#: Components of a group of queries (on average), which a task keeps.
KEPT = 1 << 22
#: Dimensions up to which a product of int8 vectors is exact in float32 (127 * 127 * 1040 < 2^24).
_EXACT = 1040


def usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components, and not zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


class Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, dims = ids, x, x.shape[1]
        top = np.abs(x).max(1)
        self.scales = top / 127
        codes = np.rint(x / np.where(self.scales > 0, self.scales, 1)[:, None]).clip(-127, 127).astype(np.int8)
        self.errors = np.sqrt(((x - codes * self.scales[:, None]) ** 2).sum(1))
        self.codes = codes.astype(np.float32 if dims <= _EXACT else np.float64)
        self.squares = (self.codes.astype(np.float64) ** 2).sum(1) * self.scales**2


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Whether they are candidates, ids and vectors (as a matrix) of the rows (candidate, id, vector) of each kind and length."""
    kind, ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2)
    starts = lists.offsets.to_numpy()
    sizes, values = np.diff(starts), lists.values.to_numpy()
    for candidate in (False, True):
        for dims in np.unique(sizes[kind == candidate]):
            at = np.flatnonzero((kind == candidate) & (sizes == dims))
            yield candidate, ids[at], values[starts[at][:, None] + np.arange(dims)]


class Met:
    """The queries of a task, of one length, and their candidates so far."""

    def __init__(self, k: int):
        self.k, self.asked, self.waiting, self.many = k, [], [], 0
        self.blocks: list[tuple[Block, list[list]]] = []

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.asked.append((ids, x))

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.waiting.append((ids, x))
        self.many += len(ids)
        if self.many >= CANDIDATES:
            self.meet()

    def meet(self) -> None:
        """All candidates that wait meet all queries."""
        for block in _cut(self.asked, QUERIES):
            self.blocks.append((block, [[] for _ in block.ids]))
        for block in _cut(self.waiting, CANDIDATES):
            for asked, heaps in self.blocks:
                tile(asked, block, heaps, self.k)
        self.asked, self.waiting, self.many = [], [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        for block, heaps in self.blocks:
            rows = [(int(block.ids[i]), int(-v), float(-d)) for i, h in enumerate(heaps) for d, v in h]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def _cut(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[Block]:
    if parts:
        ids, x = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        for i in range(0, len(ids), rows):
            yield Block(ids[i : i + rows], x[i : i + rows])


def tile(q: Block, c: Block, heaps: list[list], k: int) -> None:
    """Merge the candidates of one block into the queries' heaps of (-distance, -id)."""
    product = (q.codes @ c.codes.T).astype(np.float64) * q.scales[:, None] * c.scales[None, :]
    about = np.sqrt(np.maximum(q.squares[:, None] + c.squares[None, :] - 2 * product, 0))
    # Rounding in the squares above is far below a millionth of the lengths.
    slack = q.errors[:, None] + c.errors[None, :] + 1e-6 * (np.sqrt(q.squares)[:, None] + np.sqrt(c.squares)[None, :])
    own = q.ids[:, None] == c.ids[None, :]
    upper = np.where(own, np.inf, about + slack)
    near = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q.ids), np.inf)
    open_ = (about - slack <= np.minimum(near, [-h[0][0] if len(h) >= k else np.inf for h in heaps])[:, None]) & ~own
    for i in np.flatnonzero(open_.any(1)):
        at = np.flatnonzero(open_[i])
        exact = np.sqrt(((c.x[at] - q.x[i]) ** 2).sum(1))
        for j in np.lexsort((c.ids[at], exact))[:k]:
            entry = (-exact[j], -c.ids[at[j]])
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision): each query's k nearest rows of `vectors`.

    Rows with the query's own key are no candidates; ties go to the smaller key; all candidates if there are fewer than k.
    Unusable vectors (see `usable`) and null keys take no part, nor do vectors of other lengths than the query's. Rows that repeat a key
    are candidates each for itself; other columns are ignored; an empty table gives no rows.

    There are about as many tasks as shuffle partitions: one for each group of queries (about KEPT components) and of candidates. So a
    candidate is sent once for each group of queries, which is one group up to some ten thousand queries, and a query once for each
    group of candidates. Neither side is broadcast. Groups follow from keys alone, so a task that runs again has the same rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))

    asked, all_ = clean(queries), clean(vectors)
    kept = asked.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    groups = max(1, -(-kept // KEPT))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowds = max(1, -(-tasks // groups))

    def dealt(df: DataFrame, candidate: bool) -> DataFrame:
        """The rows, once for each task that needs them."""
        own = F.pmod(F.xxhash64("id"), F.lit(crowds if candidate else groups))
        others = F.explode(F.sequence(F.lit(0), F.lit((groups if candidate else crowds) - 1))).alias("other")
        at = F.col("other") * crowds + F.col("own") if candidate else F.col("own") * crowds + F.col("other")
        return df.select("*", own.alias("own"), others).select(at.cast("int").alias("task"), F.lit(candidate).alias("candidate"), "id", "vector")

    met = dealt(asked, False).unionByName(dealt(all_, True)).repartitionById(groups * crowds, "task").sortWithinPartitions("candidate").drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: dict[int, Met] = {}
        for batch in batches:  # queries come first
            for candidate, ids, x in by_length(batch):
                own = lengths.setdefault(x.shape[1], Met(k))
                (own.offer if candidate else own.ask)(ids, x)
        for own in lengths.values():
            own.meet()
            yield from own.found()

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
