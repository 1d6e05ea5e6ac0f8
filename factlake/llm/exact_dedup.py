"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal if they are identical without white space. Each partition sorts the fingerprints of its texts (the first bits of a
SHA-256, just enough bits for the table's number of rows) and sends every owner, which has a range of fingerprints, the sorted ones of
that range as Golomb-Rice codes of their differences. An owner answers with a bitmap of its range: the cells that hold a fingerprint
it met twice. All bitmaps together are one, whose size is bounded; it goes back to the partitions, and only texts of its cells
(suspects: all copies, and few others) are shuffled and compared byte by byte. A fuller bitmap means more suspects, never fewer copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import Workspace, as_bytes, no_shuffle_left, slices

SPACE = b" \t\n\x0b\x0c\r"
#: Fingerprints that a task holds before it sends them, and those that an owner gets on average at most.
HELD, OWNED = 1 << 20, 1 << 20
#: Bits of a fingerprint, and of a cell's number, beyond those that number the rows; and most bits of a cell's number (a bitmap of 128 MB).
SPARE, CELL_SPARE, MOST_CELL_BITS = 12, 4, 30
#: Rows of a group, and parts of the table, from which a group is joined by a broadcast; so there are at most PARTS of them.
LARGE, PARTS = 1000, 100_000


def golomb(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted numbers as Golomb-Rice codes of their differences: the bits of a remainder, all quotients in unary, all remainders."""
    steps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / len(values)
    width = max(0, int(np.ceil(np.log2(max(mean, 1) * np.log(2)))))
    ends = np.cumsum((steps >> np.uint64(width)) + np.uint64(1)).astype(np.int64)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    places = np.arange(width, dtype=np.uint64)
    rest = ((steps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return width, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_back(n: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The numbers that golomb() coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * width].reshape(n, width)
    remainders = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(width)) + remainders)


def _bare(text: bytes | None) -> bytes:
    return text.translate(None, SPACE) if text else b""


def _prefixes(digests: list[bytes], bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64) >> np.uint64(64 - bits)


def _messages(texts: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """owner, n, width, unary, rest: the sorted fingerprints of a partition for each owner, those that it has twice or more sent twice."""
    low = np.uint64(bits - owner_bits)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(held), return_counts=True)
        own = np.repeat(own, np.minimum(n, 2))
        owner = (own >> low).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        parts = np.split(own & ((np.uint64(1) << low) - np.uint64(1)), starts[1:])
        width, unary, rest = zip(*map(golomb, parts))
        return pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.array([len(p) for p in parts], pa.int32()), pa.array(width, pa.int32()), pa.array(unary, pa.binary()), pa.array(rest, pa.binary())], names=["owner", "n", "width", "unary", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            held.append(_prefixes([hashlib.sha256(_bare(t)).digest() for t in part.column(1).to_pylist()], bits))
            size += len(held[-1])
            if size >= HELD:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return texts.mapInArrow(run, "owner int, n int, width int, unary binary, rest binary")


def _duplicates(messages: DataFrame, bits: int, owner_bits: int, cell_bits: int) -> bytes:
    """The owners' answers as one bitmap of all cells, 2 ** cell_bits bits whatever the table's size."""
    wide, coarse = 1 << (cell_bits - owner_bits), np.uint64(bits - cell_bits)

    def answer(table: pa.Table) -> pa.Table:
        met = np.sort(np.concatenate([golomb_back(*m) for m in zip(*(table.column(i).to_pylist() for i in range(1, 5)))]))
        cells = np.zeros(wide, np.uint8)
        cells[(met[1:][met[1:] == met[:-1]] >> coarse).astype(np.int64)] = 1
        return pa.table({"owner": table.column(0)[:1], "cells": pa.array([np.packbits(cells).tobytes()], pa.binary())})

    full = bytearray(1 << (cell_bits - 3))
    for r in messages.groupBy("owner").applyInArrow(answer, "owner int, cells binary").collect():
        full[r.owner * wide >> 3 : (r.owner + 1) * wide >> 3] = r.cells
    return bytes(full)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] = [], spare: int = SPARE) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256 (of the text without white space), and the columns
    `carry` in a struct `row`.

    Of equal texts the row with the most code points stays, then that of the smallest key (a null key comes last), then any one.
    Null texts are empty ones, and all empty texts are equal. Repeated rows are copies of each other. An empty table has no rows.
    spare: fingerprint bits beyond those that number the rows; fewer only mean more suspects.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    count = docs.count()
    rows = max(1, count.bit_length())
    bits = min(60, max(6, rows + spare))
    owner_bits = min(bits - 3, max(5, rows - OWNED.bit_length() + 1))
    cell_bits = min(bits, max(owner_bits + 3, min(rows + CELL_SPARE, MOST_CELL_BITS)))
    # The first column is a placeholder, as slices() cuts by the second.
    texts = docs.select(F.lit(0).alias("id"), as_bytes(text).alias("bytes"))
    with no_shuffle_left(spark):
        bitmap = spark.sparkContext.broadcast(_duplicates(_messages(texts, bits, owner_bits), bits, owner_bits, cell_bits))
    source = docs.select(F.monotonically_increasing_id().alias("at"), as_bytes(text).alias("bytes"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), F.col(f"`{key}`").alias("key"), F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"))
    schema = T.StructType([source.schema["at"], source.schema["chars"], source.schema["key"], source.schema["row"], T.StructField("sha", T.BinaryType()), T.StructField("suspect", T.BooleanType()), T.StructField("bare", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(bitmap.value, np.uint8)
        for part in slices(batches):
            bare = [_bare(t) for t in part.column(1).to_pylist()]
            sha = [hashlib.sha256(t).digest() for t in bare]
            cell = _prefixes(sha, cell_bits).astype(np.int64)
            suspect = (cells[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            seen: set[bytes] = set()
            sent = [None if not s or t in seen else seen.add(t) or t for t, s in zip(bare, suspect.tolist())]  # a slice's copies once
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(sha, pa.binary()), pa.array(suspect), pa.array(sent, pa.binary())], names=[f.name for f in schema])

    known = work.keep(source.mapInArrow(run, schema))
    suspects = known.filter("suspect")
    different = suspects.filter("bare is not null").select("sha", "bare").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("texts"))
    best = suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("key").isNull().alias("none"), "key", "at")).alias("best"))
    checked = work.keep(best.join(different, "sha").withColumn("size", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts of one SHA-256")))))
    work.finish(known, checked)
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = known.filter("not suspect").select("row", "key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    large = F.col("size") >= max(LARGE, count // PARTS)
    near = suspects.select("row", "key", "at", "sha").join(F.broadcast(checked.filter(large).select("sha", F.struct("size", "best").alias("group"))), "sha", "left")
    rest = near.filter("group is null").drop("group").join(checked.filter(~large).select("sha", "size", "best"), "sha")
    met = near.filter("group is not null").select("row", "key", "at", "sha", "group.size", "group.best").unionByName(rest).select("row", "key", F.col("best.key").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.at") == F.col("at")).alias("kept"), digest)
    return alone.unionByName(met).select(F.col("key").alias(key), "keep_id", "group_size", "kept", "text_sha256", *(["row"] if carry else []))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay (see groups), with their columns."""
    return groups(docs, key, text, docs.columns).filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
