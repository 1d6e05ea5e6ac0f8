"""Packing of documents into sequences of bounded length.

Bounded-space online packing: each partition keeps a fixed number of open windows. What is left of a document after whole
sequences goes where it fits best; if it fits nowhere, the fullest window is topped up with the start of it and emitted.
Windows still open at the end of a partition are merged in a second, small pass, so that padding is left in one sequence a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import bpe
from factlake.llm.common import Workspace, slices

#: Tokens that one task of the second pass merges, about.
MERGE_TOKENS = 1 << 22
_FLUSH = 4096


class Packer:
    """Open windows of one partition. A piece is (key, start, ids, doc_tokens), its ids little-endian 32-bit numbers."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.windows, self.next = size, windows, base
        self.room: list[tuple[int, int]] = []  # free tokens and number of each open window, the fullest first
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple], left: bool = False) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.done.append((key, start, len(ids) // 4, ids, total, self.next, at, left))
            at += len(ids) // 4
        self.next += 1

    def add(self, key, start: int, ids: bytes, total: int) -> None:
        size = self.size
        at, n = 0, len(ids) // 4
        while n - at >= size:
            self._emit([(key, start + at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        while at < n:
            i = bisect_left(self.room, (n - at, -1))
            if i < len(self.room):
                free, w = self.room.pop(i)
                take = n - at
            elif len(self.room) < self.windows:
                w = max(self.open, default=-1) + 1
                self.open[w], free, take = [], size, n - at
            else:
                free, w = self.room.pop(0)
                take = free
            self.open[w].append((key, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if free > take:
                insort(self.room, (free - take, w))
            else:
                self._emit(self.open.pop(w))

    def close(self, left: bool) -> None:
        for _, w in self.room:
            self._emit(self.open[w], left)


def pack(docs: DataFrame, path: str, size: int = 2048, windows: int = 64, end_id: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of documents, each id of each in exactly one: key, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (within its sequence, without gaps) and, with keep_ids, ids (array of int).

    A document's ids are those of the tokenizers library (add_special_tokens=False) and then end_id, so null and empty texts have
    one. A null key is carried; repeated rows are packed each for itself. Sequences hold at most `size` ids. All but one
    sequence a merging group are full. Nothing but the open windows' ids (windows * size a partition at most) is shuffled.
    """
    spark = docs.sparkSession
    raw, work, kind = bpe.vocabulary(spark, path), Workspace(spark, "pack"), docs.schema[key].dataType
    columns = [T.StructField(key, kind), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("left", T.BooleanType())))]
    schema = T.StructType(columns)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in columns])

    def flush(packer: Packer) -> pa.RecordBatch:
        rows, packer.done = packer.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, end = bpe.model(raw.value), bpe.pieces(raw.value, fast=True), end_id.to_bytes(4, "little")
        packer = Packer(size, windows, TaskContext.get().partitionId() << 32)
        for part in slices(batches):
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = (m.merge_text(t, known) if t else b"") + end
                packer.add(k, 0, ids, len(ids) // 4)
                if len(packer.done) >= _FLUSH:
                    yield flush(packer)
        packer.close(left=True)
        if packer.done:
            yield flush(packer)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, 1, 1 << 62 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packer.add(*row)
            if len(packer.done) >= _FLUSH:
                yield flush(packer)
        packer.close(left=False)
        if packer.done:
            yield flush(packer)

    ids = F.col("ids") if keep_ids else F.when(F.col("left"), F.col("ids"))
    packed = work.keep(docs.select(key, text).mapInArrow(first, schema).select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "left", ids.alias("ids")))
    left = packed.filter("left")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    merged = left.repartition(tokens // MERGE_TOKENS + 1, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset").select(key, "start", "ids", "doc_tokens").mapInArrow(second, schema)
    out = packed.filter("not left").drop("left").unionByName(merged.withColumn("ids_crc32", F.crc32("ids")).drop("left"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not keep_ids:
        return out.select(*names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = b"".join(batch.column(7).to_pylist())
            lengths = pa.array([0, *batch.column(2).to_pylist()], pa.int32())
            ends = pa.compute.cumulative_sum(lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)]))], names=[*names, "ids"])

    shown = T.StructType([*(f for n in names for f in out.schema if f.name == n), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return out.select(*names, "ids").mapInArrow(unpack, shown)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
