"""Helpers shared by the training-data operators: word hashing, bounded slices of Arrow batches, tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker processes at once.
SLICE_BYTES = 4 << 20
#: Bytes whose words are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        at = tempfile.mkdtemp(prefix="factlake-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def no_shuffle_left(spark: SparkSession, **more: str) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted when it is written. more: further settings for that time, by the last part
    of their names under spark.sql.execution.arrow."""
    wanted = {_CLEANUP: "true"} | {f"spark.sql.execution.arrow.{k}": v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables written to the shared folder, which cut the lineage. finish() deletes those that the result doesn't read; the rest goes when
    Python exits, or with clear()."""

    roots: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: dict[int, DataFrame] = {}
        self.count = 0
        Workspace.roots[self.root] = spark

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Write a table and read it again. Its shuffle files are deleted as soon as it is written."""
        self.count += 1
        at = f"{self.root}/{self.count}"
        with no_shuffle_left(self.spark):
            df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kept_at = at
        self.kept[self.count] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, df._kept_at)
        self.kept = {n: df for n, df in self.kept.items() if df not in tables}

    def finish(self, *read: DataFrame) -> None:
        """Delete all tables but these, which the operator's result reads."""
        self.drop(*[df for df in self.kept.values() if not any(df is r for r in read)])

    @classmethod
    def clear(cls) -> None:
        """Delete all workspaces of this application. Results not written by then are lost."""
        for root, spark in cls.roots.items():
            if spark.sparkContext._jsc is not None:  # stopped: its folder goes with the cluster's own clean-up
                _delete(spark, root)
        cls.roots = {}


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(Workspace.clear)


def few_rows(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` distinct texts (all, if there are no more), chosen by a hash of the text alone: the same ones however the table is
    cut or ordered, copies once. The table is scanned once for the number of distinct texts (HyperLogLog); no row passes a single task."""
    hashed = docs.select(F.col(text).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    different = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if different <= rows:
        return hashed.groupBy("h").agg(F.min("t").alias("t")).select("t")
    top = int((1 << 62) * rows / different)
    return hashed.filter(F.shiftrightunsigned("h", 2) < top).groupBy("h").agg(F.min("t").alias("t")).select("t")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes (polynomials modulo 2^64, then mixed) of all n consecutive word hashes; by doubling, so in log n passes."""
    have, out = 1, words
    parts: list[tuple[int, np.ndarray]] = []
    left, done, total = n, 0, None
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                parts.append((have, out))
            left >>= 1
            if left:
                power = np.uint64(pow(int(_ODD), have, 1 << 64))
                out = out[: max(0, len(out) - have)] * power + out[have:]
                have *= 2
        size = max(0, len(words) - n + 1)
        total = np.zeros(size, np.uint64)
        for span, h in parts:
            total = total * np.uint64(pow(int(_ODD), span, 1 << 64)) + h[done : done + size]
            done += span
    return mix(total)


def slices(batches: Iterator, budget: int = SLICE_BYTES) -> Iterator:
    """Parts of Arrow batches whose text column (the second) holds at most `budget` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([len(x) if x is not None else 0 for x in batch.column(1).to_pylist()]) if batch.column(1).nbytes > budget else None
        if sizes is None:
            yield batch
            continue
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + budget, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class _Bytes:
    """Bytes that end words, and a random 64-bit number for each byte at each of 64 places of a word."""

    PLACES = 64
    code = np.arange(256, dtype=np.uint8)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    plain = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _ODD)
    folded = plain.reshape(64, 256)[:, np.where((code >= 65) & (code <= 90), code + 32, code)].ravel()


def _block_words(texts: list[bytes | None], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, and each text's number of words."""
    data = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    gap = _Bytes.space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, end = edge[::2], edge[1::2]
    ends = np.cumsum([1 + len(t or b"") for t in texts])
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(np.r_[0, first].astype(np.int32), np.diff(np.r_[0, first, len(data)]))
    with np.errstate(over="ignore"):
        total = (_Bytes.folded if fold else _Bytes.plain).take(((place & (_Bytes.PLACES - 1)) << 8) | data)
        if len(first) and (end - first).max() > _Bytes.PLACES:  # each further run of places has a factor of its own
            row = place // _Bytes.PLACES
            factor = mix(np.arange(int(row.max()) + 1, dtype=np.uint64)) | np.uint64(1)  # 1 for the first
            total *= factor.take(row)
        np.cumsum(total, out=total)
        words = mix(total[end - 1] - total[first - 1] + (end - first).astype(np.uint64) * _ODD)
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def hash_words(texts: list[bytes | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one after another, and the offsets at which each text begins (one more at the end).
    fold: A-Z are lower-cased. Each byte at each place of a word has a pseudo-random number, and a word's hash is the mixed sum of
    these: numpy makes those of a block at once, and no pattern of letters makes long words collide, as it does for polynomials."""
    words, counts, start, held = [], [np.zeros(1, np.int64)], 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= BLOCK_BYTES or i == len(texts) - 1:
            w, n = _block_words(texts[start : i + 1], fold)
            words.append(w)
            counts.append(n)
            start, held = i + 1, 0
    return np.concatenate(words) if words else np.empty(0, np.uint64), np.cumsum(np.concatenate(counts))


def as_bytes(column: str = "text") -> Column:
    """A text column's UTF-8 bytes, so that Python needn't decode them. bytes.split() cuts at exactly space and \\x09-\\x0D."""
    return F.col(column).cast("binary")
