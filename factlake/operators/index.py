"""Sums of token scores of texts, from the words that the texts have.

A token of [a-z0-9_-] lies inside a text exactly if it lies inside one of the text's runs of such characters. So tokens are matched with
distinct words, and no text is searched for a token.

Queries go to the texts: a task matches each distinct word of a batch with the tokens once, makes its texts' scores by arrays, and gives on only
what a ranking may keep. Where the queries are too many for that, the distinct words of all texts meet the tokens by way of their
three-character grams, and postings are joined by word, hits by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct tokens up to which they are broadcast; pairs of a text with a word or of a query with a token that a task makes at once; and queries, with their scopes and
#: 32 tokens each, up to which they go to the texts. Beyond these the joins shuffle.
MOST_TOKENS, MOST_PAIRS, FEW_QUERIES = 1 << 16, 1 << 21, 1 << 14
#: Rows of a ranking up to which a task holds it; and of the arrays that a task makes at once, the sums and the texts' tokens.
MOST_HELD, SUMS, CELLS = 1 << 21, 1 << 22, 1 << 24
# Odd factors of hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Parts of a token's texts where many queries meet them.
SALTS = 32
# What separates words of facts, and those of topic files.
FACT_WORDS, FILE_WORDS = "[^a-z0-9_-]+", "[^a-z0-9]+"


def _words(field: Column, pattern: str) -> Column:
    """The distinct words of two characters or more of a field, lower-cased; a null field has none."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(field, F.lit(""))), pattern)), lambda w: F.length(w) >= 2)


def postings(rows: DataFrame, keys: list[str], fields: dict[str, int], pattern: str = FACT_WORDS) -> DataFrame:
    """keys, word, weight: the words of each field, with the field's weight."""
    found = [F.transform(_words(F.col(c), pattern), _with(F.lit(n), "word")) for c, n in fields.items()]
    return rows.select(*keys, F.inline(F.concat(*found)))


def _with(weight: Column, name: str):
    return lambda x: F.struct(x.alias(name), weight.alias("weight"))


def _grams(word: Column, n: int) -> Column:
    places = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(word, i, F.lit(n)))


def matches(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """word, token of the tokens (two characters or more) that each distinct word contains. A word meets the tokens that begin with one of its grams."""
    own = words.select("word", F.explode(F.array_distinct(F.concat(_grams(F.col("word"), 2), _grams(F.col("word"), 3)))).alias("gram"))
    wanted = tokens.select("token", F.substring("token", 1, 3).alias("gram"))
    wanted = F.broadcast(wanted) if tokens.count() <= MOST_TOKENS else wanted
    return own.join(wanted, "gram").filter(F.contains("word", F.col("token"))).select("word", "token")


def scores(rows: DataFrame, keys: list[str], fields: dict[str, int], asked: DataFrame, pattern: str = FACT_WORDS, best: tuple[int, dict[str, bool]] | None = None) -> DataFrame:
    """query_id, keys, n, raw: for each query and each row with one of its tokens, the sum over its tokens of the largest weight of a field that has it.

    rows: distinct by keys, of which `scope` is one; a row meets the queries of its scope, and one with a null scope meets every query, once. asked:
    query_id, scope, tokens (distinct, n of them). best: how many rows of each query and scope a ranking keeps, and the keys that it goes by after
    raw, with whether they descend: others may be left out.
    """
    many, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    if many <= FEW_QUERIES and size <= 32 * FEW_QUERIES:
        return _in_place(rows, keys, fields, asked, pattern, best if best and 2 * many * best[0] <= MOST_HELD else None)
    known = matches(postings(rows, [], fields, pattern).select("word").distinct(), asked.select(F.explode("tokens").alias("token")).distinct())
    found = _hits(rows, keys, fields, known, pattern)
    every = asked.select("query_id", "tokens").distinct()
    return _totals(found.filter("scope is not null"), keys, asked, ["scope"], many).unionByName(_totals(found.filter("scope is null"), keys, every, [], many))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of each, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and where the last one ends, in the bytes of all."""
    offsets, data = (np.frombuffer(b or b"", t) for b, t in zip(texts.buffers()[1:], (np.int32, np.uint8)))
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1] if len(offsets) else np.zeros(1, np.int32)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class _Asked:
    """Tokens by word, and queries by scope and token, as arrays."""

    def __init__(self, asked: pa.Table):
        self.tokens = asked.column("tokens").to_pylist()
        names = sorted({t for ts in self.tokens for t in ts})
        self.number = {t: i for i, t in enumerate(names)}
        self.size = len(names)
        self.tokens_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: hashes, ascending; numbers; bytes; which first bits they have
        for n in {len(t) for t in names}:
            own = np.array([self.number[t] for t in names if len(t) == n], np.int32)
            letters = np.frombuffer("".join(names[i] for i in own).encode(), np.uint8).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for i in range(n):
                h = h * STEP + letters[:, i]
            at, few = np.argsort(h), np.zeros(1 << 16, bool)
            few[(h * MIX) >> np.uint64(48)] = True
            self.tokens_of[n] = h[at], own[at], letters[at], few
        self.query_ids = asked.column("query_id").combine_chunks()
        rows: dict[object, list[int]] = {None: []}  # by scope; without one, each query once
        seen: set[str] = set()
        for i, (q, scope) in enumerate(zip(self.query_ids.to_pylist(), asked.column("scope").to_pylist())):
            rows.setdefault(scope, []).append(i)
            if str(q) not in seen:
                seen.add(str(q))
                rows[None].append(i)
        self.rows = {scope: np.array(own, np.int64) for scope, own in rows.items() if own}
        self.lengths = np.array([len(ts) for ts in self.tokens], np.int64)
        self.lists: dict[object, tuple[np.ndarray, np.ndarray]] = {}

    def of_scope(self, scope: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Where each token's part begins, and in the parts the places of the scope's queries that have it."""
        if scope not in self.lists:
            at = np.array([(self.number[t], j) for j, i in enumerate(self.rows[scope]) for t in self.tokens[i]], np.int64).reshape(-1, 2)
            at = at[np.argsort(at[:, 0], kind="stable")]
            self.lists[scope] = np.searchsorted(at[:, 0], np.arange(self.size + 1)), at[:, 1]
        return self.lists[scope]

    def inside(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens that words contain: where each word's begin, how many there are, and all of them. Parts of words are looked up by hash, length by length, and compared."""
        offsets, data = _buffers(words)
        many = np.diff(offsets)
        word, end = np.repeat(np.arange(len(words)), many), np.repeat(offsets[1:], many)
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        met, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for n in range(1, max(self.tokens_of, default=0) + 1):
            fits = end[at] - at >= n
            at, h = at[fits], h[fits]
            h = h * STEP + data[at + (n - 1)]
            if n in self.tokens_of:
                hashes, numbers, letters, few = self.tokens_of[n]
                near = np.flatnonzero(few[(h * MIX) >> np.uint64(48)])
                place = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
                near, place = near[hashes[place] == h[near]], place[hashes[place] == h[near]]
                same = (data[at[near][:, None] + np.arange(n)] == letters[place]).all(axis=1)
                met.append(word[at[near[same]]])
                found.append(numbers[place[same]])
        of, tokens = np.concatenate(met), np.concatenate(found)
        size = np.bincount(of, minlength=len(words))
        return np.cumsum(size) - size, size, tokens[np.argsort(of, kind="stable")]

    def field(self, texts: pa.StringArray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each lower-cased text's words begin, their numbers, and by number the beginning and length of their parts of the last array, the tokens.
        inside: which bytes words consist of."""
        offsets, data = _buffers(texts)
        is_word = inside[data]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        begins[first] = is_word[first]
        at = np.r_[np.flatnonzero(begins[is_word]), np.count_nonzero(is_word)].astype(np.int32)
        d = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data[is_word])).dictionary_encode()
        return np.searchsorted(np.flatnonzero(begins), offsets), d.indices.to_numpy(), *self.inside(d.dictionary)

    def sums(self, scope: str | None, texts: np.ndarray, fields: list[tuple[int, tuple]]) -> np.ndarray:
        """Sums by text and query of a scope. fields: weights, ascending, and what field() gives."""
        best = np.zeros((len(texts), self.size), np.int64 if fields[-1][0] > 127 else np.int8)
        for weight, (offsets, code, first, size, tokens) in fields:
            many = (offsets[texts + 1] - offsets[texts]).astype(np.int64)
            words, row = code[_ranges(offsets[texts].astype(np.int64), many)], np.repeat(np.arange(len(texts)), many)
            best[np.repeat(row, size[words]), tokens[_ranges(first[words], size[words])]] = weight
        row, token = np.nonzero(best)
        begin, queries = self.of_scope(scope)
        size = np.diff(begin)[token]
        width = len(self.rows[scope])
        place = np.repeat(row * width, size) + queries[_ranges(begin[token], size)]
        return np.bincount(place, np.repeat(best[row, token], size), len(texts) * width).astype(np.int64).reshape(-1, width)

    def chunks(self, scope: str | None, texts: np.ndarray, fields: list[tuple[int, tuple]]) -> Iterator[np.ndarray]:
        """The texts in groups whose arrays stay small."""
        begin, queries = self.of_scope(scope)
        step = max(1, min(SUMS // len(self.rows[scope]), CELLS // max(self.size, 1), MOST_PAIRS // max(len(queries), 1)))
        words = np.cumsum(sum(offsets[texts + 1] - offsets[texts] for _, (offsets, *_) in fields).astype(np.int64))
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(words, (words[at - 1] if at else 0) + MOST_PAIRS, "right"))
            to = min(at + step, max(at + 1, to))
            yield texts[at:to]
            at = to


class Best:
    """The best rows of groups, by a value and then by other columns, from tables that come one after another."""

    def __init__(self, groups: int, limit: int, by: dict[str, bool]):
        self.limit, self.by, self.parts, self.rows, self.kept = limit, by, [], 0, 0
        self.bar = np.full(groups, -np.inf)  # the value of a group's last row, once it has all

    def order(self, table: pa.Table, first: list[tuple[str, str]] = []) -> np.ndarray:
        """The table's rows in the order of the other columns; null is the least of values, as in Spark's default order."""
        keys = list(first)
        for c, falling in self.by.items():
            if not falling and table.column(c).null_count:
                table = table.append_column(f"{c}__there", pc.is_valid(table.column(c)))
                keys.append((f"{c}__there", "ascending"))
            keys.append((c, "descending" if falling else "ascending"))
        return pc.sort_indices(table, sort_keys=keys).to_numpy()

    def add(self, table: pa.Table) -> None:
        """table: `__group`, `__value` and the columns."""
        if table.num_rows:
            self.parts.append(table)
            self.rows += table.num_rows
            if self.rows > max(1 << 17, 2 * self.kept):
                self.shrink()

    def shrink(self) -> pa.Table | None:
        if not self.parts:
            return None
        whole = pa.concat_tables(self.parts).combine_chunks()
        whole = whole.take(pa.array(self.order(whole, [("__group", "ascending"), ("__value", "descending")])))
        group, value = whole.column("__group").to_numpy(), whole.column("__value").to_numpy()
        place = np.arange(len(group)) - np.searchsorted(group, group)
        last = place == self.limit - 1
        self.bar[group[last]] = value[last]
        whole = whole.filter(pa.array(place < self.limit))
        self.parts, self.rows, self.kept = [whole], whole.num_rows, whole.num_rows
        return whole


def by_value(column: pa.Array) -> dict[object, np.ndarray]:
    """The rows of each value of a column."""
    codes = column.dictionary_encode(null_encoding="encode")
    at = codes.indices.to_numpy()
    return {v: np.flatnonzero(at == i) for i, v in enumerate(codes.dictionary.to_pylist())}


def _in_place(rows: DataFrame, keys: list[str], fields: dict[str, int], asked: DataFrame, pattern: str, best: tuple[int, dict[str, bool]] | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(asked.select("query_id", "scope", "tokens").toArrow())  # FEW_QUERIES at most
    weights = sorted(fields.items(), key=lambda x: x[1])
    source = rows.select(*keys, *[F.lower(F.coalesce(c, F.lit(""))).alias(f"text{i}") for i, (c, _) in enumerate(weights)])
    inside = np.array([c < 128 and not re.match(pattern, chr(c)) for c in range(256)])
    schema = T.StructType([asked.schema["query_id"], *[source.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("raw", T.LongType())])
    own, scope_at = len(keys), keys.index("scope")

    def found(q: _Asked, b: pa.RecordBatch, top: Best | None) -> Iterator[pa.Table]:
        """Tables of keys, `__group` and `__value`: a query's row, twice, with 1 for a null scope, and the sum."""
        read = [(w, q.field(b.column(own + i), inside)) for i, (_, w) in enumerate(weights)]
        table = pa.table([b.column(i) for i in range(own)], names=keys)
        place = np.empty(b.num_rows, np.int64)
        order = top.order(table) if top else np.arange(b.num_rows)
        place[order] = np.arange(b.num_rows)
        for scope, texts in by_value(b.column(scope_at)).items():
            if scope not in q.rows:
                continue
            groups = 2 * q.rows[scope] + (scope is None)
            for part in q.chunks(scope, texts[np.argsort(place[texts])], read):
                sums = q.sums(scope, part, read).T
                if top:
                    # Texts are in the ranking's order, so that a sum and a place are one number that no two of a query share.
                    least = np.maximum(top.bar[groups], 1)[:, None]
                    value = np.where(sums >= least, sums * len(part) + np.arange(len(part))[::-1], -1)
                    some = np.argpartition(value, len(part) - top.limit, axis=1)[:, -top.limit :] if top.limit < len(part) else np.broadcast_to(np.arange(len(part)), value.shape)
                    query, at = np.nonzero(np.take_along_axis(value, some, 1) >= 0)
                    text = some[query, at]
                else:
                    query, text = np.nonzero(sums)
                yield table.take(pa.array(part[text])).append_column("__group", pa.array(groups[query])).append_column("__value", pa.array(sums[query, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, top = _Asked(shared.value), None
        if best:
            top = Best(2 * len(q.lengths), *best)

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            row = t.column("__group").to_numpy() // 2
            made = pa.table([q.query_ids.take(pa.array(row)), *(t.column(k) for k in keys), pa.array(q.lengths[row]), t.column("__value")], names=schema.names)
            yield from made.combine_chunks().to_batches(1 << 14)

        for b in batches:
            for t in found(q, b, top):
                if top:
                    top.add(t)
                else:
                    yield from out(t)
        if top and (t := top.shrink()) is not None:
            yield from out(t)

    return source.mapInArrow(run, schema)


def _hits(rows: DataFrame, keys: list[str], fields: dict[str, int], known: DataFrame, pattern: str) -> DataFrame:
    """keys, found: for each row with a hit, the tokens that its fields contain with the largest weight of a field that does."""
    met = postings(rows, keys, fields, pattern).join(known.groupBy("word").agg(F.collect_list("token").alias("tokens")), "word").select(*keys, "weight", F.explode("tokens").alias("token"))
    # A row a text goes through the shuffle; its tokens are made distinct before it. A token counts for its best field.
    weights = sorted(set(fields.values()), reverse=True)
    sets = met.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("weight") == w, F.col("token"))).alias(f"of_{w}") for w in weights])
    found, better = [], F.array().cast("array<string>")
    for w in weights:
        own = F.array_except(f"of_{w}", better)
        found.append(F.transform(own, _with(F.lit(w), "token")))
        better = F.concat(better, own)
    return sets.select(*keys, F.concat(*found).alias("found"))


def _totals(found: DataFrame, keys: list[str], asked: DataFrame, on: list[str], many: int) -> DataFrame:
    """query_id, keys, n, raw: the sum of the weights of each query's tokens in each row of _hits() that has one of them.

    asked: query_id, tokens (distinct), and what else `on` joins by. many: its rows.
    """
    rows = found.select(*keys, F.inline("found"))
    each = asked.select("query_id", *on, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    if many <= FEW_QUERIES:
        met = rows.join(F.broadcast(each), [*on, "token"])
    else:
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("salt")
        met = rows.select("*", salt).join(each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "token", "salt"])
    return met.groupBy("query_id", *keys).agg(F.first("n").cast("long").alias("n"), F.sum("weight").alias("raw"))
