"""What rows and queries of one scope have in common, where the queries go to the rows: nearest vectors by blocks, and texts that hold others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlake.operators import index as X

#: Products of a block, how far they may lie from sums in the order of the components (those of vectors of length 1), bytes of text taken at once, and bytes of a text by which it is found.
PRODUCTS, APART, BYTES, HEAD = 1 << 22, 1e-9, 1 << 20, 16


def _matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this width and no null, and their components."""
    many, values = vectors.value_lengths().fill_null(-1).to_numpy(), vectors.flatten()
    first = np.cumsum(np.maximum(many, 0)) - np.maximum(many, 0)
    null = np.r_[0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]
    is_whole = (many == width) & (null[first + np.maximum(many, 0)] == null[first])
    flat = values.fill_null(0.0).to_numpy()
    return is_whole, flat[first[is_whole][:, None] + np.arange(width)]


def _few_copies(own: np.ndarray, limit: int) -> np.ndarray:
    """The rows but those that have `limit` equal ones before them."""
    _, same = np.unique(np.ascontiguousarray(own).view(np.dtype((np.void, own.shape[1] * 8))).ravel(), return_inverse=True)
    at = np.argsort(same, kind="stable")
    place = np.arange(len(at)) - np.searchsorted(same[at], same[at])
    return np.sort(at[place < limit])


def _block(own: np.ndarray, asked: np.ndarray, whole: np.ndarray, bar: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, row, score and whether there is one, of all pairs that may be among a query's nearest.

    own: vectors of the rows that are `whole`; the others have no score. The product only leaves out; scores are summed in the order of the components.
    """
    near = np.full((len(asked), len(whole)), -np.inf)
    if own.shape[1]:
        rows = np.flatnonzero(whole)
        some = _few_copies(own, limit)
        with np.errstate(all="ignore"):
            found = asked @ own[some].T
        near[:, rows[some]] = np.where(np.isnan(found), np.inf, found)
    low = bar
    if len(whole) > limit and np.isneginf(bar).any():
        low = np.maximum(bar, np.partition(near, len(whole) - limit, axis=1)[:, -limit])
    q, r = np.nonzero((near > -np.inf) & (near >= (low - APART)[:, None]))
    score = np.zeros(len(q))
    where = np.cumsum(whole) - 1
    with np.errstate(all="ignore"):
        for i in range(own.shape[1]):
            score += own[where[r], i] * asked[q, i]
    # Rows without a score fill what is left, by id. Copies that were left out aren't among them.
    open_ = np.flatnonzero(np.isneginf(low))
    blank = np.broadcast_to(~whole, (len(open_), len(whole)))
    q2, r2 = np.nonzero(blank & (np.cumsum(blank, axis=1) <= limit))
    return np.r_[q, open_[q2]], np.r_[r, r2], np.r_[score, np.zeros(len(q2))], np.r_[np.ones(len(q), bool), np.zeros(len(q2), bool)]


def nearest(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """query_id, score and the columns of rows (scope, id, own, ...) but `own`: for each query (query_id, scope, vector), which go to all tasks, all rows of its scope that
    may be among its `limit` nearest by the product with own, ties by id; a product is null as it is in SQL, and then comes last; NaN comes first."""
    shared = rows.sparkSession.sparkContext.broadcast(asked.select("query_id", "scope", "vector").toArrow())
    keys = [c for c in rows.columns if c != "own"]
    source = rows.select(*keys, "own")
    schema = T.StructType([asked.schema["query_id"], *[source.schema[k] for k in keys], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value.combine_chunks()
        top, vectors, widths = X.Best(q.num_rows, limit, {"id": False}), q.column("vector").combine_chunks(), []
        known = np.zeros(q.num_rows, bool)
        for n in set(vectors.value_lengths().drop_null().to_pylist()) - {0}:
            is_whole, own = _matrix(vectors, n)
            widths.append((n, is_whole, own))
            known |= is_whole
        widths.append((0, ~known, np.empty((np.count_nonzero(~known), 0))))
        groups = {}  # by scope: width, queries, and their vectors
        for scope, at in X.by_value(q.column("scope").combine_chunks()).items():
            of = [(n, at[is_whole[at]], own[(np.cumsum(is_whole) - 1)[at[is_whole[at]]]]) for n, is_whole, own in widths]
            groups[scope] = [g for g in of if len(g[1])]
        for b in batches:
            table = pa.table([b.column(i) for i in range(len(keys))], names=keys)
            place = np.empty(b.num_rows, np.int64)
            place[top.order(table)] = np.arange(b.num_rows)
            for scope, at in X.by_value(b.column(keys.index("scope"))).items():
                at = at[np.argsort(place[at])]
                for n, queries, asked_ in groups.get(scope, []) if scope is not None else []:
                    step = max(2 * limit, PRODUCTS // len(queries))
                    for part in (at[i : i + step] for i in range(0, len(at), step)):
                        whole, own = _matrix(b.column(len(keys)).take(pa.array(part)), n) if n else (np.zeros(len(part), bool), np.empty((0, 0)))
                        query, row, score, there = _block(own, asked_, whole, top.bar[queries], limit)
                        value = np.where(there, np.where(np.isnan(score), np.inf, score), -np.inf)
                        top.add(table.take(pa.array(part[row])).append_column("score", pa.array(score, mask=~there)).append_column("__group", pa.array(queries[query])).append_column("__value", pa.array(value)))
        if (t := top.shrink()) is not None:
            made = pa.table([q.column("query_id").combine_chunks().take(t.column("__group").combine_chunks()), *(t.column(k) for k in keys), t.column("score")], names=schema.names)
            yield from made.combine_chunks().to_batches(1 << 14)

    return source.mapInArrow(run, schema)


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes, a power of two, from each place on."""
    h, step, factor = data.astype(np.uint64), 1, np.array([X.STEP])  # arrays wrap without a warning
    while step < n:
        h = h[: len(h) - step] * factor + h[step:] if len(h) > step else h[:0]
        step, factor = 2 * step, factor * factor
    return h


def holding(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, key: the facts (scope, id, data) of a query's scope that hold its whole text. Queries (query_id, scope, query) go to all tasks; a text is
    found by the hash of its first bytes, and then compared."""
    shared = facts.sparkSession.sparkContext.broadcast(asked.select("query_id", "scope", "query").filter("query is not null").toArrow())
    source = facts.select("scope", "id", "data").filter("data is not null and scope is not null")
    schema = T.StructType([asked.schema["query_id"], T.StructField("key", source.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.column("query_id").combine_chunks()
        by_text: dict[bytes, dict[str, list[int]]] = {}
        for i, (text, scope) in enumerate(zip(shared.value.column("query").to_pylist(), shared.value.column("scope").to_pylist())):
            by_text.setdefault(text.encode(), {}).setdefault(scope, []).append(i)
        by_hash: dict[int, dict[int, list[bytes]]] = {}
        for text in filter(None, by_text):
            n = min(HEAD, 1 << len(text).bit_length() - 1)
            by_hash.setdefault(n, {}).setdefault(int(_hashes(np.frombuffer(text[:n], np.uint8), n)[0]), []).append(text)
        lists = {}
        for n, texts in by_hash.items():
            hashes, few = np.array(sorted(texts), np.uint64), np.zeros(1 << 20, bool)
            few[(hashes * X.MIX) >> np.uint64(44)] = True
            lists[n] = hashes, few

        def met(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[bytes, int]]:
            """Texts asked, and the rows that may hold them."""
            for n, (hashes, few) in lists.items():
                for at in range(0, len(data), BYTES):
                    h = _hashes(data[at : at + BYTES + n - 1], n)
                    near = np.flatnonzero(few[(h * X.MIX) >> np.uint64(44)])
                    place = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
                    near, place = near[hashes[place] == h[near]], place[hashes[place] == h[near]]
                    row = np.searchsorted(offsets, near + at, "right") - 1
                    for r, p in set(zip(row.tolist(), place.tolist())):
                        yield from ((text, r) for text in by_hash[n][int(hashes[p])])
            if b"" in by_text:
                yield from ((b"", r) for r in range(len(offsets) - 1))

        for b in batches:
            scopes, data = b.column(0).to_pylist(), b.column(2)
            offsets, flat = X._buffers(data)
            found = set()
            for text, r in set(met(offsets, flat)):
                if scopes[r] in by_text[text] and text in flat[offsets[r] : offsets[r + 1]].tobytes():
                    found |= {(i, r) for i in by_text[text][scopes[r]]}
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), b.column(1).take(pa.array(pairs[:, 1]))], names=schema.names)

    return source.mapInArrow(run, schema)
