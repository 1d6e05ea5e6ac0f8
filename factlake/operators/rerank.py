"""Re-ranking a query's hits for diversity."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from factlake.functions import text as T


def trigrams(text: str) -> set[str]:
    """As text.trigrams() has them: a text of fewer than three characters is one."""
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))} if text else set()


def _order(scores: list[float], ranks: list[int], grams: list[set[str]], weight: float) -> list[int]:
    """Places in the order in which they are taken. A value only falls as more are taken, so a heap of old values finds the greatest one: its top is
    brought up to date with those taken since, and is taken if it stays on top."""
    best = max(0.0, *scores) or 1.0
    near, seen, taken = [0.0] * len(scores), [0] * len(scores), []
    value = lambda i: weight * scores[i] / best - (1 - weight) * near[i]
    heap = [(-value(i), ranks[i], i) for i in range(len(scores))]
    heapq.heapify(heap)
    while heap:
        _, _, i = heap[0]
        if seen[i] == len(taken):
            heapq.heappop(heap)
            taken.append(i)
            continue
        for j in taken[seen[i] :]:
            both = len(grams[i] & grams[j])
            if both:
                near[i] = max(near[i], both / (len(grams[i]) + len(grams[j]) - both))
        seen[i] = len(taken)
        heapq.heapreplace(heap, (-value(i), ranks[i], i))
    return taken


def diverse(hits: DataFrame, weight: float = 1.0) -> DataFrame:
    """hits (query_id, key, data, score, rank) with their new rank, by greedy maximal marginal relevance.

    Each step takes the hit with the greatest weight * score / best score - (1 - weight) * similarity to its most similar hit taken so
    far (trigrams' Jaccard index); ties go to the earlier rank. No hit is added or lost. A query's hits are one group of a task: a list of
    thousands takes few comparisons more than it has near copies at its head, as hits are compared only when they reach the top.
    """
    if weight >= 1:
        return hits
    share = max(weight, 0.0)
    schema = hits.select("query_id", "key").schema.add("place", T_.LongType())

    def run(group: pa.Table) -> pa.Table:
        grams = [trigrams(t) for t in group.column("text").to_pylist()]
        taken = pa.array(_order(group.column("score").to_pylist(), group.column("rank").to_pylist(), grams, share), pa.int64())
        return pa.table({"query_id": group.column("query_id").take(taken), "key": group.column("key").take(taken), "place": pa.array(range(1, len(taken) + 1), pa.int64())})

    rows = hits.select("query_id", "key", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.lower(T.squeeze(F.col("data"))).alias("text"))
    return hits.drop("rank").join(rows.groupBy("query_id").applyInArrow(run, schema), ["query_id", "key"]).withColumnRenamed("place", "rank")
