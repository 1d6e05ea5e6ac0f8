"""Phrases of several words that belong together, with exact counts held in the slots of a minimal perfect hash.

Candidates come level by level: a phrase can reach the least count only if its first and its last words, one fewer, do (Apriori), so
partitions send only the keys of such phrases, each once with its count. A bounded bitmap of the level below does the pruning; where it
is too full it prunes less and drops nothing. All candidates, the words among them included, then get a minimal perfect hash
(levels of bit arrays; a key's slot is the number of bits before its own) with their keys stored by slot. Each task counts its texts'
phrases in a numpy array of all slots, taking a slot only if its stored key is the phrase's; the arrays are summed in a tree. Where
there are more candidates than one broadcast may hold, several passes take a range of them each. Exact up to 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import Workspace, _Bytes, as_bytes, mix, rolling, slices

#: Bytes of text whose words are hashed at once; a longer text is cut between words.
BLOCK = 1 << 18
#: Phrases that a task holds before it sends their counts.
HELD = 1 << 20
#: Most bits of a pruning bitmap's cell numbers (32 MB), and bits beyond those that number its keys.
MOST_CELL_BITS, CELL_SPARE = 28, 4
#: Slots that one broadcast holds (about 70 MB); slots of a shard, which is built, sent and summed by itself; and arrays summed at once.
SLOTS, SHARD, FAN = 1 << 22, 1 << 14, 16
#: Counts by slot up to which they are broadcast to look up parts (some 16 MB); beyond it they are joined.
FEW_COUNTS = 1 << 20
#: Parts of a group in which its first rows are sought before they are ranked together.
PARTS = 64

_STOPS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_SEPARATOR = re.compile(b"[ \t.,;:!?\n-\r]")
_STOP = np.isin(np.arange(256), list(_STOPS))
_GAP = _STOP | np.isin(np.arange(256), list(_BLANKS))


def _chunks(text: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about BLOCK bytes that cut no word, each with `ahead` further words; and how many of its bytes are its own."""
    start = 0
    more = re.compile(b"(?:[ \t.,;:!?\n-\r]*[^ \t.,;:!?\n-\r]+){0,%d}" % ahead)
    while start < len(text):
        cut = _SEPARATOR.search(text, start + BLOCK)
        stop = cut.end() if cut else len(text)
        yield text[start : more.match(text, stop).end()], stop - start
        start = stop


class Block:
    """Words of several texts: hashes, where they begin and end in `data`, their text's row, their piece, and whether they are
    the block's own (words at its end may be there only to end phrases)."""

    def __init__(self, chunks: list[tuple[bytes, int, int]], group_keys: np.ndarray):
        self.data = (b"\n" + b"\n".join(c for c, _, _ in chunks) + b"\n").lower()
        data = np.frombuffer(self.data, np.uint8)
        gap = _GAP[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.first, self.end = edge[::2], edge[1::2]
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(np.r_[0, self.first].astype(np.int32), np.diff(np.r_[0, self.first, len(data)]))
        with np.errstate(over="ignore"):
            total = _Bytes.plain.take(((place & (_Bytes.PLACES - 1)) << 8) | data)
            if len(self.first) and (self.end - self.first).max() > _Bytes.PLACES:  # each further run of places has a factor of its own
                row = place // _Bytes.PLACES
                total *= (mix(np.arange(int(row.max()) + 1, dtype=np.uint64)) | np.uint64(1)).take(row)
            np.cumsum(total, out=total)
            self.words = mix(total[self.end - 1] - total[self.first - 1] + (self.end - self.first).astype(np.uint64))
        starts = 1 + np.cumsum([0, *(len(c) + 1 for c, _, _ in chunks[:-1])])
        chunk = np.searchsorted(starts, self.first, "right") - 1
        self.own = self.first < starts[chunk] + np.array([n for _, n, _ in chunks])[chunk]
        self.row = np.array([r for _, _, r in chunks])[chunk]
        self.piece = np.cumsum(_STOP[data], dtype=np.int32)[self.first]
        self.group_key = group_keys[self.row]

    def keys(self, n: int) -> np.ndarray:
        """Of the n words from each word on, of its group."""
        k = rolling(self.words, n)
        with np.errstate(over="ignore"):
            return mix(k + self.group_key[: len(k)])

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece, and the first is the block's own."""
        size = max(0, len(self.words) - n + 1)
        return self.own[:size] & (self.piece[:size] == self.piece[n - 1 : n - 1 + size])

    def phrase(self, at: int, n: int) -> str:
        """The words, with one blank between."""
        return b" ".join(re.findall(b"[^ \t]+", self.data[self.first[at] : self.end[at + n - 1]])).decode("utf-8", "replace")


def _blocks(part: pa.RecordBatch, longest: int) -> Iterator[Block]:
    """The words of a slice (id, text, group)."""
    groups, code = np.unique([g.encode() for g in part.column(2).to_pylist()], return_inverse=True)
    seed = np.frombuffer(b"".join(hashlib.blake2b(bytes(g), digest_size=8).digest() for g in groups), np.uint64)
    group_keys, held, size = seed[code], [], 0
    for row, text in enumerate(part.column(1).to_pylist()):
        for chunk, own in _chunks(text or b"", longest - 1):
            held.append((chunk, own, row))
            size += len(chunk)
            if size >= BLOCK:
                yield Block(held, group_keys)
                held, size = [], 0
    if held:
        yield Block(held, group_keys)


class Tally:
    """Counts of keys, each with a text that holds it (by the text's id) and that text's group, sent when they get too many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, texts: np.ndarray, groups: np.ndarray) -> None:
        if len(keys):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            self.parts.append((key, n, texts[first], groups[first]))
            self.size += len(key)

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n, texts, groups = map(np.concatenate, zip(*self.parts))
            key, first, back = np.unique(keys, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(back, n).astype(np.int64)), pa.array(texts[first]), pa.array(groups[first].tolist(), pa.string())], names=["key", "n", "text", "group"])
        self.parts, self.size = [], 0


class Cells:
    """A bitmap of keys by their first bits."""

    def __init__(self, raw: bytes):
        self.bits, self.shift = np.frombuffer(raw, np.uint8), np.uint64(64 - (len(raw).bit_length() + 2))

    def has(self, keys: np.ndarray) -> np.ndarray:
        cell = (keys >> self.shift).astype(np.int64)
        return (self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _cells(keys: DataFrame, count: int) -> bytes:
    """The bitmap of a table's keys, made by range and put together; its size is bounded whatever the number of keys."""
    bits = min(MOST_CELL_BITS, max(11, count.bit_length() + CELL_SPARE))
    wide = 1 << (bits - 8)

    def mark(table: pa.Table) -> pa.Table:
        cells = np.zeros(wide, np.uint8)
        cells[(table.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) & (wide - 1)] = 1
        return pa.table({"part": table.column("part")[:1], "cells": pa.array([np.packbits(cells).tobytes()], pa.binary())})

    full = bytearray(1 << (bits - 3))
    for r in keys.select("key", F.shiftrightunsigned("key", 56).cast("int").alias("part")).groupBy("part").applyInArrow(mark, "part int, cells binary").collect():
        full[r.part * wide >> 3 : (r.part + 1) * wide >> 3] = r.cells
    return bytes(full)


def _seed(level: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))


def perfect_hash(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """A minimal perfect hash of distinct keys: sizes of its levels in bits, all their bits, and the keys in the order of their slots.

    Each key sets a bit of the first level; those that meet another there go on to the next. A key's slot is the number of bits
    before its own.
    """
    sizes, bits, placed, left = [], [], [], keys
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = (mix(left ^ _seed(len(sizes))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        placed.append(left[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~mine]
    return sizes, np.concatenate(bits).tobytes() if bits else b"", np.concatenate(placed) if placed else keys


class Slots:
    """The perfect hashes of several shards (shard, sizes, bits, keys, texts), as one; keys are dealt to shards by their first bits."""

    def __init__(self, shards: list[tuple], shard_bits: int):
        depth, most = max(len(s[1]) for s in shards), 1 << shard_bits
        self.shift = np.uint64(64 - shard_bits)
        self.size, self.offset = np.zeros((depth, most), np.int64), np.zeros((depth, most), np.int64)
        at = 0
        for shard, sizes, _, _, _ in shards:
            for level, size in enumerate(sizes):
                self.size[level, shard], self.offset[level, shard] = size, at
                at += size
        self.bits = np.frombuffer(b"".join(s[2] for s in shards), np.uint64)
        self.before = np.cumsum(np.r_[0, np.bitwise_count(self.bits)])
        self.keys = np.frombuffer(b"".join(s[3] for s in shards), np.uint64)
        self.texts = np.frombuffer(b"".join(s[4] for s in shards), np.int64)
        self.shards = [s[0] for s in shards]
        self.ends = np.cumsum([len(s[3]) // 8 for s in shards])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for keys that have none."""
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        shard = (keys >> self.shift).astype(np.int64)
        for level in range(len(self.size)):
            size = self.size[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.offset[level, shard[left]] + (mix(keys[left] ^ _seed(level)) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            slot[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below[hit])
            left = left[~hit]
        known = slot >= 0
        slot[known] = np.where(self.keys[slot[known]] == keys[known], slot[known], -1)
        return slot


_BROADCASTS: dict[str, object] = {}


def _once(name: str, make):
    """Made once in each worker, for its last few names."""
    if name not in _BROADCASTS:
        if len(_BROADCASTS) >= 8:
            _BROADCASTS.clear()
        _BROADCASTS[name] = make()
    return _BROADCASTS[name]


def _candidates(texts: DataFrame, size: int, longest: int, below: tuple | None) -> DataFrame:
    """key, n, text, group of the phrases of `size` words that a partition has, if the cells of the level below hold both their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _once(below[0], lambda: Cells(below[1].value)) if below else None
        tally = Tally()
        for part in slices(batches):
            ids, groups = part.column(0).to_numpy(), np.array(part.column(2).to_pylist(), object)
            for b in _blocks(part, longest):
                ok = b.whole(size)
                if cells:
                    inside = cells.has(b.keys(size - 1))
                    ok &= inside[:-1] & inside[1:]
                keys, rows = b.keys(size)[ok], b.row[: len(ok)][ok]
                tally.add(keys, ids[rows], groups[rows])
            if tally.size >= HELD:
                yield from tally.send()
        yield from tally.send()

    return texts.mapInArrow(run, "key long, n long, text long, group string")


def _shards(keys: DataFrame, shard_bits: int) -> DataFrame:
    """The perfect hash of each shard of a table's keys (key, text)."""

    def build(table: pa.Table) -> pa.Table:
        own = table.column("key").to_numpy().view(np.uint64)
        sizes, bits, placed = perfect_hash(own)
        order = np.argsort(own)
        texts = table.column("text").to_numpy()[order[np.searchsorted(own[order], placed)]]
        return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(own)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary()), "texts": pa.array([texts.tobytes()], pa.binary())})

    shard = F.shiftrightunsigned("key", 64 - shard_bits).cast("int").alias("shard")
    return keys.select("key", "text", shard).groupBy("shard").applyInArrow(build, "shard int, n long, sizes array<long>, bits binary, keys binary, texts binary")


def _count(texts: DataFrame, name: str, slots, cells: list, longest: int) -> DataFrame:
    """Each partition's counts by slot, in shards; and, for each phrase, a row of the text that stands for it: its words and its parts' keys."""
    columns = "shard int, task int, counts binary, key long, size int, group string, phrase string, heads array<long>, tails array<long>, inside array<long>"
    kinds = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("counts", pa.binary()), ("key", pa.int64()), ("size", pa.int32()), ("group", pa.string()), ("phrase", pa.string()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _once(name, lambda: Slots(*slots.value))
        filters = [_once(n, lambda b=b: Cells(b.value)) for n, b in cells]
        counts = np.zeros(len(table.keys), np.int64)
        for part in slices(batches):
            ids, groups, told = part.column(0).to_numpy(), part.column(2).to_pylist(), []
            for b in _blocks(part, longest):
                keys, below = [b.keys(n) for n in range(1, longest + 1)], None
                signed = [k.view(np.int64) for k in keys]
                for n in range(1, longest + 1):
                    has = filters[n - 1].has(keys[n - 1])
                    ok = b.whole(n) & has if below is None else b.whole(n) & has & below[:-1] & below[1:]
                    below = has
                    at = np.flatnonzero(ok)
                    slot = table.of(keys[n - 1][at])
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    counts += np.bincount(slot, minlength=len(counts))
                    if n == 1:
                        continue
                    mine = np.flatnonzero(table.texts[slot] == ids[b.row[at]])
                    for i in at[mine[np.unique(slot[mine], return_index=True)[1]]].tolist():
                        key = lambda o, k: int(signed[k - 1][i + o])  # noqa: B023, E731
                        told.append({"key": key(0, n), "size": n, "group": groups[b.row[i]], "phrase": b.phrase(i, n), "heads": [key(0, k) for k in range(1, n)], "tails": [key(k, n - k) for k in range(1, n)], "inside": [key(o, k) for k in range(2, n) for o in range(n - k + 1)]})
            if told:
                yield pa.RecordBatch.from_pylist(told, schema=kinds)
        task, start = TaskContext.get().partitionId(), 0
        for shard, end in zip(table.shards, table.ends.tolist()):
            own = counts[start:end]
            if own.any():
                yield pa.RecordBatch.from_pylist([{"shard": shard, "task": task, "counts": own.tobytes()}], schema=kinds)
            start = end

    return texts.mapInArrow(run, columns)


def _summed(arrays: DataFrame, tasks: int) -> DataFrame:
    """shard, counts: the sum of all tasks' arrays, FAN at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        return pa.table({"shard": table.column("shard")[:1], "task": table.column("task")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = arrays.select("shard", "task", "counts")
    while True:
        tasks = -(-tasks // FAN)
        out = out.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("shard", "task").applyInArrow(add, "shard int, task int, counts binary")
        if tasks <= 1:
            return out


def _first(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """Each group's first rows with their rank: first those of parts of a group, so that no task sorts a whole one."""
    part = rows.withColumn("part", F.pmod("key", F.lit(PARTS)))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).filter(F.col("rank") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def phrases(docs: DataFrame, text: str = "text", by: str = "lang", key: str = "doc_id", least: int = 30, longest: int = 4, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each group's first `top` phrases of two to `longest` words that occur `least` times or more.

    A text's words are lower-cased (A-Z), cut at blanks and tabs, and phrases stay between stops (. , ; : ! ? and line ends). a counts a
    phrase, n all words of the group. A cut into two parts with counts l and r scores floor(2000000 a / (l + r)); the lowest cut counts,
    of equal ones the earliest. Phrases inside a longer one that has at least 80 % of their count are left out.

    Null and empty texts have no words; a null group is `und`, and rows of it count together. Repeated rows count as often as they
    are there; ties go by count, then by the phrase's bytes. An empty table has no rows. Null and repeated keys are no matter: the key only
    chooses the text from which a phrase is written out. Further columns aren't read. Very long texts are cut between words.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "phrases")
    texts = docs.select(F.xxhash64(F.col(f"`{key}`")).alias("id"), as_bytes(text).alias("bytes"), F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("und")).alias("group"))

    words = work.keep(_candidates(texts, 1, longest, None).groupBy("group", "key").agg(F.sum("n").alias("n"), F.min("text").alias("text")))
    totals = words.groupBy("group").agg(F.sum("n").alias("words"))
    levels = [words.filter(F.col("n") >= least).select("key", "text")]
    cells = []
    for size in range(1, longest + 1):
        if size > 1:
            found = _candidates(texts, size, longest, cells[-1]).groupBy("key").agg(F.sum("n").alias("n"), F.min("text").alias("text"))
            levels.append(work.keep(found.filter(F.col("n") >= least).select("key", "text")))
        cells.append((f"{work.root}-{size}", spark.sparkContext.broadcast(_cells(levels[-1], levels[-1].count()))))

    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    shard_bits = max(3, (every.count() // SHARD).bit_length())
    shards = work.keep(_shards(every, shard_bits))
    counted, told = None, None
    for number, (low, high) in enumerate(_passes([(r.shard, r.n) for r in shards.select("shard", "n").orderBy("shard").collect()])):
        held = [(r.shard, r.sizes, r.bits, r.keys, r.texts) for r in shards.filter(F.col("shard").between(low, high)).orderBy("shard").collect()]
        slots = spark.sparkContext.broadcast((held, shard_bits))
        seen = work.keep(_count(texts, f"{work.root}-slots-{number}", slots, cells, longest))
        slots.unpersist()
        tasks = (seen.agg(F.max("task")).first()[0] or 0) + 1
        sums = _summed(seen.filter("shard is not null"), tasks)
        counted = sums if counted is None else counted.unionByName(sums)
        own = seen.filter("shard is null").drop("shard", "task", "counts")
        told = own if told is None else told.unionByName(own)
    if counted is None:
        work.finish()
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")

    def by_key(table: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(table.column(c)[0].as_py(), np.int64) for c in ("keys", "counts"))
        return pa.table({"key": keys, "a": counts})

    counts = work.keep(counted.join(shards.select("shard", "keys"), "shard").groupBy("shard").applyInArrow(by_key, "key long, a long"))
    known = F.broadcast(counts) if counts.count() <= FEW_COUNTS else counts
    found = work.keep(told.dropDuplicates(["key"]).join(known, "key").filter(F.col("a") >= least))
    work.finish(words, counts, found)

    part = lambda c: known.select(F.col("key").alias(c), F.col("a").alias(f"of_{c}"))
    cuts = found.select("key", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("cut", "parts")).select("key", "a", "cut", F.col("parts.heads").alias("head"), F.col("parts.tails").alias("tail"))
    cuts = cuts.join(part("head"), "head").join(part("tail"), "tail")
    score = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(19, 0)) div cast(of_head + of_tail as decimal(20, 0))")
    worst = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "cut", "of_head", "of_tail")).alias("worst"))
    longer = found.select(F.explode("inside").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    out = found.join(longer, "key", "left").filter("longer is null or 100 * cast(longer as decimal(19, 0)) < 80 * cast(a as decimal(19, 0))").join(worst, "key")
    flat = out.select("key", F.col("group").alias("lang"), "phrase", "a", F.col("worst.of_head").alias("l"), F.col("worst.of_tail").alias("r"), F.col("worst.score").alias("score"))
    first = _first(flat, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return first.join(F.broadcast(totals.withColumnRenamed("group", "lang")) if totals.count() <= FEW_COUNTS else totals.withColumnRenamed("group", "lang"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def _passes(shards: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive shards that have at most SLOTS slots together, or are one shard."""
    low, size, last = None, 0, None
    for shard, n in shards:
        if low is not None and size + n > SLOTS:
            yield low, last
            low, size = None, 0
        low = shard if low is None else low
        size, last = size + n, shard
    if low is not None:
        yield low, last
