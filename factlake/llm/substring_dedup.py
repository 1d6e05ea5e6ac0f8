"""Removal of repeated passages, by Rabin-Karp hashes of every window of a fixed number of words.

Every window's hash is computed; those that can repeat are shuffled and counted. A window's anchor is the smallest hash of its
5-word windows, so equal windows have equal anchors, and consecutive windows with one anchor form a run. Anchors (about a fifth as
many as windows) are counted first: where one has a single run, nothing repeats; where its runs are the same everywhere, they repeat
as wholes; only for other anchors the windows themselves are compared. Removed windows merge into maximal intervals.

Counts by anchor and by window are aggregates that combine on the map side, joined back to the rows of those that repeat, so that a
passage that many texts share isn't one task's work. For that the texts are hashed again; no table of all anchors is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import Workspace, as_bytes, hash_words, mix, rolling, slices

WINDOW, ANCHOR = 13, 5


class Windows:
    """All windows of several texts: hash, text, position, anchor and run of each."""

    def __init__(self, texts: list[bytes | None], size: int):
        self.words, self.starts = hash_words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        n = max(0, len(self.words) - size + 1)
        self.at = np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n])
        self.doc = doc[self.at]
        self.position = self.at - self.starts[self.doc]
        self.hash = rolling(self.words, size)[self.at]
        short = min(ANCHOR, size)
        grams, span = rolling(self.words, short), size - short + 1
        lowest, have = grams, 1  # smallest of the next `have` grams
        while n and 2 * have <= span:
            lowest = np.minimum(lowest[:-have], lowest[have:])
            have *= 2
        if n and have < span:
            lowest = np.minimum(lowest[:n], lowest[span - have : span - have + n])
        self.anchor = lowest[self.at] if n else np.empty(0, np.uint64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1

    def contents(self) -> np.ndarray:
        """A hash of each run: of its windows in order."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.at)) - self.first[self.run]
        with np.errstate(over="ignore"):
            return np.add.reduceat(mix(self.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), self.first)


def _grouped(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, then owner, and where its groups begin."""
    order = np.lexsort((owners, keys))
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """key, doc, note (4 * tag + met), content. One row (met: 0, or 1 if other rows of its slice have the anchor) for each anchor of a
    slice of texts: the anchor, the smallest doc, and its run's hash. Further rows (met: 2) for all docs of an anchor that its slice
    holds twice: a key of their own, the doc, and the anchor. Four numbers a row, as these rows are most of what is
    shuffled; a run's hash has 48 bits, as it is compared among the runs of one anchor only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
            w = Windows(part.column(1).to_pylist(), size)
            if not len(w.at):
                continue
            row = w.doc[w.first]
            anchor, content, doc = w.anchor[w.first], w.contents(), ids[row]
            order, begin = _grouped(anchor, doc)
            anchor, content, doc, row = anchor[order], content[order], doc[order], row[order]
            many = np.diff(np.r_[begin, len(order)])
            # Twice with one doc counts, too, as its runs may differ.
            inside = np.repeat(many > 1, many)
            again = inside & ~np.r_[False, (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1])]
            with np.errstate(over="ignore"):
                own = mix(anchor[again] + mix(doc[again].astype(np.uint64)))
            tag = tags[row]
            met = np.r_[(many > 1).astype(np.int64), np.full(int(again.sum()), 2)]
            note = (np.r_[tag[begin], tag[again]].astype(np.int64) << 2) | met
            columns = [np.r_[anchor[begin], own].view(np.int64), np.r_[doc[begin], doc[again]], note, np.r_[content[begin] >> np.uint64(16), anchor[again]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "doc", "note", "content"])

    return docs.mapInArrow(run, "key long, doc long, note long, content long")


def candidate_windows(docs: DataFrame, size: int, schema_names: list[str]) -> DataFrame:
    """key, doc, tag, start, stop, sure: the windows of anchors in `compare`. Windows that a smaller doc of the same slice has are sure
    to go, so that only one row for each hash of a slice remains to be compared; sure ones are merged into intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = (b.select([schema_names.index(c) for c in ("doc", "text", "compare", "tag")]) for b in batches)
        for part in slices(ordered):
            ids, tags = part.column(0).to_numpy(), part.column(3).to_numpy()
            w = Windows(part.column(1).to_pylist(), size)
            wanted = np.zeros(len(w.at), bool)
            bounds = np.searchsorted(w.doc, np.arange(len(ids) + 1))
            for i, keys in enumerate(part.column(2)):
                if len(keys.values):
                    wanted[bounds[i] : bounds[i + 1]] = np.isin(w.anchor[bounds[i] : bounds[i + 1]].view(np.int64), keys.values.to_numpy())
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            h, doc, row, position = w.hash[at], ids[w.doc[at]], w.doc[at], w.position[at]
            order, begin = _grouped(h, doc)
            least = np.empty(len(at), np.int64)
            least[order] = np.repeat(doc[order][begin], np.diff(np.r_[begin, len(order)]))
            sure = doc > least
            s_row, s_at, s_doc = row[sure], position[sure], doc[sure]
            new = np.r_[True, (s_row[1:] != s_row[:-1]) | (s_at[1:] != s_at[:-1] + 1)] if len(s_at) else np.empty(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(s_at)] - 1 if len(first) else first
            open_ = ~sure
            with np.errstate(over="ignore"):
                own = mix(mix(s_doc[first].astype(np.uint64)) + s_at[first].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[h[open_], own].view(np.int64)), pa.array(np.r_[doc[open_], s_doc[first]]), pa.array(tags[np.r_[row[open_], s_row[first]]]), pa.array(np.r_[position[open_], s_at[first]].astype(np.int32)), pa.array(np.r_[position[open_] + size, s_at[last] + size].astype(np.int32)), pa.array(np.r_[np.zeros(open_.sum(), bool), np.ones(len(first), bool)])],
                names=["key", "doc", "tag", "start", "stop", "sure"],
            )

    return docs.mapInArrow(run, "key long, doc long, tag int, start int, stop int, sure boolean")


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` with n_words, n_removed, removed (maximal intervals of removed words: array of start, stop) and kept_text.

    Words are runs of bytes other than space and \\x09-\\x0D. A word goes if a window of `size` words that covers it also starts in a
    row with a smaller key; windows are judged on the input. kept_text holds the other words, joined by one space. Null and
    empty texts, and those with fewer words, lose nothing. Rows with a null key neither lose words nor count as sources; rows that share
    a key are no smaller than each other; a hash of the text tells them apart. Columns named like the results are replaced.
    """
    made = ("n_words", "n_removed", "removed", "kept_text")
    shown = [c for c in docs.columns if c not in made]
    rest = [c for c in shown if c != text]  # the text itself is shuffled once
    source = docs.select(F.col(key).cast("long").alias("doc"), as_bytes(text).alias("text"), F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    known = source.filter("doc is not null")

    work = Workspace(docs.sparkSession, "substring-dedup")
    found = anchors(known.select("doc", "text", "tag"), size).selectExpr("*", "note & 3 as met")
    seen = found.filter("met < 2").groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("doc").alias("least"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("met").alias("within"))
    seen = work.keep(seen.filter("many > 1 or within > 0").selectExpr("key", "least", "lo = hi and within = 0 as whole"))
    # An anchor's only text, its smallest doc where its runs are the same everywhere, and texts that have rows of their own need no row here.
    met = found.filter("met <> 1").join(seen, "key", "left").filter("met = 2 or whole is not null and not (whole and doc = least)")
    whole = F.coalesce("whole", F.lit(False))
    met = met.select("doc", F.expr("cast(shiftright(note, 2) as int)").alias("tag"), whole.alias("whole"), F.when(F.col("met") == 2, F.col("content")).otherwise(F.col("key")).alias("anchor"))
    told = work.keep(met.groupBy("doc", "tag").agg(F.collect_list(F.when(F.col("whole"), F.col("anchor"))).alias("gone"), F.collect_list(F.when(~F.col("whole"), F.col("anchor"))).alias("compare")))
    work.drop(seen)

    compared = known.join(told.filter("size(compare) > 0").select("doc", "tag", "compare"), ["doc", "tag"]).select("doc", "text", "tag", "compare")
    windows = work.keep(candidate_windows(compared, size, compared.columns))
    least = windows.filter("not sure").groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).filter("least < last").select("key", "least")
    spans = work.keep(windows.join(least, "key", "left").filter("sure or doc > least").select("doc", "tag", "start", "stop"))
    work.drop(windows)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cuts = work.keep(told.join(spans, ["doc", "tag"], "left").filter("size(gone) > 0 or spans is not null").select("doc", "tag", "gone", "spans"))
    work.finish(cuts)
    final = known.join(cuts, ["doc", "tag"], "left").select("doc", "text", "rest", "gone", "spans")
    unkeyed = source.filter("doc is null").select("doc", "text", "rest", F.lit(None).cast("array<long>").alias("gone"), F.lit(None).cast(cuts.schema["spans"].dataType).alias("spans"))
    interval = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([source.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", interval), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, gone, spans = part.column(1).to_pylist(), part.column(3), part.column(4)
            hit = [i for i in range(len(texts)) if gone[i].is_valid and len(gone[i].values)]
            w = Windows([texts[i] for i in hit], size)
            bounds = np.searchsorted(w.doc, np.arange(len(hit) + 1))
            runs: dict[int, np.ndarray] = {}
            for j, i in enumerate(hit):
                a, b = bounds[j], bounds[j + 1]
                runs[i] = w.position[a:b][np.isin(w.anchor[a:b].view(np.int64), gone[i].values.to_numpy())]
            counts, removed, intervals, kept = [], [], [], []
            for i, t in enumerate(texts):
                words = t.split() if t else []
                edge = np.zeros(len(words) + 1, np.int32)
                if i in runs:
                    edge[: len(words)] += np.bincount(runs[i], minlength=len(words)).astype(np.int32)
                    edge[size:] -= np.bincount(runs[i], minlength=len(words))[: len(words) + 1 - size].astype(np.int32)
                if spans[i].is_valid and len(spans[i].values):
                    fields = spans[i].values
                    np.add.at(edge, fields.field("start").to_numpy(), 1)
                    np.add.at(edge, fields.field("stop").to_numpy(), -1)
                covered = np.cumsum(edge[:-1]) > 0
                counts.append(len(words))
                removed.append(int(covered.sum()))
                turns = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                intervals.append([{"start": int(x), "stop": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                kept.append((b" ".join([x for x, c in zip(words, covered, strict=True) if not c]) if removed[-1] else b" ".join(words)).decode())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(intervals, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string())], names=["rest", "text", *made])

    out = final.unionByName(unkeyed).mapInArrow(run, schema)
    return out.select(*[F.col("text" if c == text else f"rest.`{c}`").alias(c) for c in shown], *made)
