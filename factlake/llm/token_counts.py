"""Token counts by a two-tier look-up on the map side.

First tier: a table of the most frequent pre-tokens' lengths in tokens, fitted on a bounded sample and broadcast. Second tier:
a bounded cache in each worker, which encodes what it misses. Pre-tokens are never shuffled, and the result does not depend on the sample.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import bpe
from factlake.llm.common import few_rows

#: Distinct texts from which the first tier is fitted, about, and its pre-tokens (2 MB or so). Both bound speed only.
SAMPLE_ROWS, FREQUENT = 2_000, 1 << 16


class Lengths(dict):
    """The first tier; what it lacks goes to the worker's cache of encoded pre-tokens."""

    def __init__(self, frequent: dict[str, int], known: bpe.Pieces):
        super().__init__(frequent)
        self.known = known

    def __missing__(self, piece: str) -> int:
        return len(self.known[piece]) // 4


_LENGTHS: dict[int, Lengths] = {}


def _lengths(number: int, frequent: dict[str, int], known: bpe.Pieces) -> Lengths:
    """Built once in each worker for a broadcast table of this number."""
    if number not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[number] = Lengths(frequent, known)
    return _LENGTHS[number]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", rows: int = SAMPLE_ROWS, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample (see few_rows), counted in its partitions and then together."""
    raw = bpe.vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        m, known = bpe.model(raw.value), bpe.pieces(raw.value)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for special, x in m.cut_text(t or ""):
                    if not special:
                        seen.update(p for p in bpe.split(x) if len(p) <= bpe.PIECE_CHARS)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([len(known[x]) // 4 for x in seen], pa.int32())], names=["piece", "n", "tokens"])

    counted = few_rows(docs, text, rows).mapInArrow(run, "piece string, n long, tokens int")
    top = counted.groupBy("piece", "tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return {r.piece: r.tokens for r in top.select("piece", "tokens").collect()}


def count_tokens(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """docs with each whole text's number of tokens (add_special_tokens=False); null and empty texts have 0.

    A column named `column` is replaced. Rows are independent; repeated rows get equal counts. No shuffle of texts or pre-tokens.
    """
    spark = docs.sparkSession
    raw, frequent = bpe.vocabulary(spark, path), spark.sparkContext.broadcast(frequent_lengths(docs, path, text))
    number = uuid.uuid4().int

    def convert(texts: pa.Array) -> pa.Array:
        m, lengths = bpe.model(raw.value), _lengths(number, frequent.value, bpe.pieces(raw.value))
        return pa.array([sum(1 if special else sum(map(lengths.__getitem__, bpe.split(x))) for special, x in m.cut_text(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return bpe._map(docs, text, column, T.LongType(), convert)
