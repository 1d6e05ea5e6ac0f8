"""Approximate vector search with filters: inverted lists over centroids, with as many lists probed as a query's scope needs.

Centroids come from k-means over a bounded sample; every row is assigned to its nearest one. How many eligible rows each scope has in each list is
counted, so how far a query must widen its probing to meet enough of them is a running sum, known before any row is read: no scope starves, however rare
its rows are among the nearest lists. vector_leg() in operators.retrieval is the exact way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators import retrieval as R

#: Rows from which centroids and their number of probes are fitted, about, chosen by a hash of their ids; and most lists.
SAMPLE, MOST_LISTS = 1 << 14, 1 << 10


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class Lists:
    """Unit centroids, and how many of the nearest lists a query needs for the recall that was asked for."""

    centres: np.ndarray
    probes: int


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 8, recall: float = 0.95, depth: int = 40) -> Lists:
    """Inverted lists for vectors (fact_id, vector): k-means by cosine over about `sample` rows, chosen by a hash of the id. Without `lists` there are
    twice the square root of the sample's rows, MOST_LISTS at most. Null and zero vectors and those of a rare width take no part.

    probes: as many lists as held this share of the `depth` nearest rows of the sample's own vectors, on average. Take `depth` larger than a search's limit by
    the factor by which its filters thin out the rows. Vectors that form groups need few lists; those that don't need most of them.
    """
    rows = vectors.filter("vector is not null").select(F.xxhash64("fact_id").alias("h"), "vector")
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.shiftrightunsigned("h", 2) < int((1 << 62) * sample / n))
    found = [r.vector for r in rows.orderBy("h").limit(2 * sample).collect()]
    found = [v for v in found if None not in v and any(v)]
    if not found:
        return Lists(np.zeros((0, 0)), 0)
    width = Counter(map(len, found)).most_common(1)[0][0]
    m = _unit(np.array([v for v in found if len(v) == width], np.float64))
    k = min(MOST_LISTS, len(m), lists or max(1, round(2 * np.sqrt(len(m)))))
    centres = m[np.linspace(0, len(m) - 1, k).astype(int)]  # the order is a hash's, so these are spread at random
    for _ in range(rounds):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        held = np.bincount(near, minlength=k) > 0
        centres[held] = _unit(sums[held])
    near, tried = np.argmax(m @ centres.T, axis=1), m[:: max(1, len(m) // 256)]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)  # of each list for each vector
    hits = np.argsort(-(tried @ m.T), axis=1)[:, :depth]
    needed = np.sort(np.take_along_axis(place, near[hits], axis=1).ravel())
    return Lists(centres, 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def assign(vectors: DataFrame, index: Lists) -> DataFrame:
    """fact_id, list, own (the vector made 1 long) of every vector of the centroids' width that isn't null or zero."""
    centres = index.centres
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                own = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.argmax(m @ shared.value.T, axis=1).astype(np.int32)), own], names=["fact_id", "list", "own"])

    usable = (F.size("vector") == centres.shape[1]) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())
    return vectors.filter(usable).select("fact_id", "vector").mapInArrow(run, "fact_id string, list int, own array<double>")


def _order(asked: DataFrame, centres: np.ndarray) -> DataFrame:
    """query_id, list, place: all lists of each query vector, nearest first."""
    shared = asked.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = np.argsort(-(_matrix(part.column(1)) @ shared.value.T), axis=1, kind="stable").astype(np.int32)
                k = lists.shape[1]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(lists)), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lists.ravel()), pa.array(np.tile(np.arange(k, dtype=np.int32), len(lists)))], names=["query_id", "list", "place"])

    kind = asked.schema["query_id"].dataType.simpleString()
    usable = (F.size("vector") == centres.shape[1]) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())
    return asked.filter(usable).select("query_id", "vector").mapInArrow(run, f"query_id {kind}, list int, place int")


def search(queries: DataFrame, facts: DataFrame, assigned: DataFrame, index: Lists, limit: int, spare: int = 4) -> DataFrame:
    """query_id, scope, id, ord, data, created_at, score: like vector_leg(), from the lists nearest to each query: the index's first `probes`, and further ones
    until `spare` * `limit` eligible rows of the scope (or all of them) are met. facts: those that are eligible, whatever filters made them so."""
    centres, probes = index.centres, index.probes
    asked = R._scoped(queries.select("query_id", "vector", "scopes"))
    rows = facts.select("scope", "id", "ord", "created_at").join(assigned.withColumnRenamed("fact_id", "id"), "id")
    counts = rows.groupBy("scope", "list").agg(F.count(F.lit(1)).alias("n"))
    places = asked.select("query_id", "scope").join(_order(queries, centres), "query_id").join(counts, ["scope", "list"])
    near = Window.partitionBy("query_id", "scope").orderBy("place")
    before = F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probed = places.select("query_id", "scope", "list", F.col("place"), before.alias("before")).filter((F.col("place") < probes) | (F.col("before") < spare * limit))
    wanted = probed.join(asked.select("query_id", "scope", R._unit(F.col("vector")).alias("vector")), ["query_id", "scope"]).drop("place", "before")
    many = asked.count()
    few = many * centres.shape[0] * (centres.shape[1] + 4) * 8 <= R.FEW_BYTES
    pairs = rows.join(F.broadcast(wanted) if few else wanted, ["scope", "list"]).withColumn("score", R.dot(F.col("own"), F.col("vector")))
    order = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "id")
    top = pairs.select("query_id", "scope", "id", "ord", "created_at", "score").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).drop("r")
    return R.with_texts(top, facts, ["data"], many * limit).select("query_id", "scope", "id", "ord", "data", "created_at", "score")
