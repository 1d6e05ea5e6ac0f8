"""Training-order materialisation: token sequences in a keyed pseudo-random order, in shards of fixed stride.

A Feistel network over the sequence numbers, with cycle-walking into their range, is a permutation that needs no shuffled list:
every sequence's slot follows from its number, the number of sequences and the key. Each shard holds a range of slots as
records of equal size, one after another, so a reader gets slot s at byte (s % records) * stride of shard s // records, and resumes
anywhere. Partitions are ranges of slots, whose bounds are known without a sample. A manifest names each shard's records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe
from factlake.llm.common import Workspace, mix, no_shuffle_left, slices
from factlake.llm.packing import _arrow

ROUNDS = 6


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """A permutation of range(total), for these members of it."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix((np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key % (1 << 64)))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        a, b = x >> shift, x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                a, b = b, a ^ (mix(b + k) & mask)
        out[walk] = x = a << shift | b
        walk = walk[x >= total]
    return out.astype(np.int64)


def id_code(m: bpe.Model) -> str:
    """How payloads hold ids."""
    return "<u2" if len(m.lengths) <= 1 << 16 else "<u4"


def token_records(docs: DataFrame, path: str, size: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of `size` ids cut from each partition's documents, one after another, each ended by end_id: part, local (number
    there), n_tokens (fewer than `size` in a partition's last only), keys and lengths of their documents' pieces, and payload
    (ids of two little-endian bytes, or four if the vocabulary needs it; filled up with end_id)."""
    raw = bpe.vocabulary(docs.sparkSession, path)
    kind = docs.schema[key].dataType
    key_type = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, end = bpe.model(raw.value), bpe.pieces(raw.value, fast=True), end_id.to_bytes(4, "little")
        code = id_code(m)
        part, local = TaskContext.get().partitionId(), 0
        rest, keys, lengths, rows = [], [], [], []
        free = size

        def emit() -> None:
            nonlocal free, local
            ids = np.frombuffer(b"".join(rest), "<u4")
            rows.append((part, local, len(ids), keys[:], lengths[:], np.concatenate([ids, np.full(size - len(ids), end_id)]).astype(code).tobytes()))
            rest.clear(), keys.clear(), lengths.clear()
            free, local = size, local + 1

        def flush() -> pa.RecordBatch:
            held = rows[:]
            rows.clear()
            columns = [pa.array(c) if i != 3 else None for i, c in enumerate(zip(*held, strict=True))]
            return pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), columns[1].cast(pa.int64()), columns[2].cast(pa.int32()), pa.array([r[3] for r in held], pa.list_(key_type)), columns[4].cast(pa.list_(pa.int32())), columns[5]], names=["part", "local", "n_tokens", "keys", "lengths", "payload"])

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (m.merge_text(t, known) if t else b"") + end
                at = 0
                while at < len(ids):
                    take = min(free, (len(ids) - at) // 4)
                    rest.append(ids[at : at + 4 * take])
                    keys.append(k)
                    lengths.append(take)
                    at, free = at + 4 * take, free - take
                    if not free:
                        emit()
            if rows:
                yield flush()
        if rest:
            emit()
            yield flush()

    return docs.select(key, text).mapInArrow(run, f"part int, local long, n_tokens int, keys array<{kind.simpleString()}>, lengths array<int>, payload binary")


def training_order(docs: DataFrame, path: str, order_key: int, size: int = 2048, records: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The records of all documents in training order: slot, shard, byte_offset (in its shard's file), n_tokens, keys, lengths, payload.

    Slots are 0 .. number of sequences - 1, each once; partitions hold whole shards, sorted by slot. Null and empty texts have
    one id (end_id), null keys are carried, repeated rows are sequences' parts each for itself, an empty table has no record; other
    columns are ignored. The ids are written once to the shared folder, so a lost executor costs no second encoding, and shuffled once.
    """
    placed, total = _placed(Workspace(docs.sparkSession, "training-order").keep(token_records(docs, path, size, end_id, key, text)), order_key)
    return _ordered(placed, 0, total, records)


def _placed(kept: DataFrame, order_key: int) -> tuple[DataFrame, int]:
    """The records with their slots, and how many there are."""
    counts = sorted((r.part, r.n) for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # two numbers an input partition
    total = sum(n for _, n in counts)
    parts = np.array([p for p, _ in counts], np.int64)
    first = np.cumsum([0, *(n for _, n in counts)])

    @F.pandas_udf("long")
    def slot(part: pd.Series, local: pd.Series) -> pd.Series:
        return pd.Series(slots(first[np.searchsorted(parts, part.to_numpy())] + local.to_numpy(), total, order_key))

    return kept.select(slot("part", "local").alias("slot"), "n_tokens", "keys", "lengths", "payload"), total


def _ordered(placed: DataFrame, begin: int, end: int, records: int) -> DataFrame:
    """The records of the slots from begin (a shard's first) to end, in partitions of consecutive whole shards."""
    shards = max(1, -(-(end - begin) // records))
    parts = min(shards, 8 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.floor(F.col("slot") / records)
    where = F.floor((shard - begin // records) * parts / shards).cast("int")
    out = placed.filter((F.col("slot") >= begin) & (F.col("slot") < end)).withColumn("shard", shard).withColumn("byte_offset", (F.col("slot") % records) * F.length("payload"))
    return out.repartitionById(parts, where).sortWithinPartitions("slot").select("slot", "shard", "byte_offset", "n_tokens", "keys", "lengths", "payload")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One raw file a shard, in folders shard=N: the records' payloads one after another, and one line feed at the end of the file.

    Spark's own committer writes them, so retried tasks leave no halves, on any file system that Spark knows. Shards of other
    slots that are in the folder stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["shard", "content"])

        for batch in batches:
            for s, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    if held:
                        yield whole()
                    shard, held = s, []
                held.append(payload)
        if held:
            yield whole()

    files = ordered.select("shard", "payload").mapInArrow(run, "shard long, content binary")
    with no_shuffle_left(ordered.sparkSession, maxRecordsPerBatch="512"):
        files.select("shard", F.col("content").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").mode("append").text(path)


def read_back(spark: SparkSession, path: str, stride: int, records: int) -> DataFrame:
    """slot, shard, byte_offset and ids_crc32 of each record that the files of write_shards hold. A file that ends inside a record is an
    error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                n, rest = divmod(len(data) - 1, stride)
                if rest:
                    raise ValueError(f"shard {shard}: {len(data)} bytes are no records of {stride}")
                at = np.arange(n) * stride
                yield pa.RecordBatch.from_arrays([pa.array(shard * records + np.arange(n)), pa.array(np.full(n, shard)), pa.array(at), pa.array([zlib.crc32(data[a : a + stride]) for a in at.tolist()], pa.int64())], names=["slot", "shard", "byte_offset", "ids_crc32"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"/shard=(\d+)/[^/]*$", 1).cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "slot long, shard long, byte_offset long, ids_crc32 long")


def stored_order(docs: DataFrame, path: str, at: str, order_key: int, size: int = 2048, records: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", passes: int = 4) -> DataFrame:
    """Writes the shards of training_order to the folder `at`/shards and returns what they hold: slot, shard, byte_offset, n_tokens,
    keys, lengths and ids_crc32 (of the payload, as read from the file at byte_offset).

    The shards are written in so many passes, each a range of slots, so no more than that part of the ids is in shuffle files at a
    time. Every record is then read again: one that is missing, comes twice or is not the one of its slot is an error. Last comes the
    manifest, `at`/manifest (JSON lines: shard, first_slot, records, stride, bytes), so a folder with a manifest is whole.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "training-order")
    with no_shuffle_left(spark, maxRecordsPerBatch="1024"):
        kept = work.keep(token_records(docs, path, size, end_id, key, text))
        placed, total = _placed(kept, order_key)
        told = work.keep(placed.select("slot", "n_tokens", "keys", "lengths", F.crc32("payload").alias("crc")))
    shards = -(-total // records)
    bounds = [records * (shards * i // passes) for i in range(passes)] + [total]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        if begin < end or total == 0:
            write_shards(_ordered(placed, begin, end, records), f"{at}/shards")
    work.drop(kept)
    stride = size * np.dtype(id_code(bpe.model(bpe.vocabulary(spark, path).value))).itemsize
    with no_shuffle_left(spark, maxRecordsPerBatch="1"):  # a row is a whole file
        stored = work.keep(told.join(read_back(spark, f"{at}/shards", stride, records), "slot", "full").select("slot", "shard", "byte_offset", "n_tokens", "keys", "lengths", F.when(F.col("crc") == F.col("ids_crc32"), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("no such record in the files, or another one: slot "), F.col("slot")))).alias("ids_crc32")))
    found = stored.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("records"))
    if stored.count() != total:
        raise ValueError("a slot is in the files twice")
    found.select("shard", "first_slot", "records", F.lit(stride).alias("stride"), (F.col("records") * stride + 1).alias("bytes")).write.mode("overwrite").json(f"{at}/manifest")
    work.finish(stored)
    return stored


def read_slots(data: bytes, first: int, count: int, size: int, code: str = "<u2") -> np.ndarray:
    """Records first .. first + count - 1 of a shard file's bytes (or of a part of them that begins with a record)."""
    stride = size * np.dtype(code).itemsize
    return np.frombuffer(data[first * stride : (first + count) * stride], np.uint8).reshape(-1, stride).copy().view(code)
