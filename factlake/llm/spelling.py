"""Spelling variants: words that differ by one character, by merging errata tries.

The words of a trie are split along heavy paths: at each node the largest subtree stays, and the light ones are merged into it twice, once
with their first character replaced and once with it skipped; a terminal that coincides with another word's gives a pair, and the node's
depth is where the two part. A word lies in a light subtree at most log2(n) times, so the smaller side is always the one that moves.

No task holds all words. Two words one edit apart agree outside the quarter of the word that holds the edit, so each word
goes to one bucket for each quarter, keyed by what lies outside it (and by the shorter word's length), and a bucket has its own trie. A
bucket with many words is dealt anew by quarters of its quarter, down to one character. A pair is found in one bucket only: that
whose quarter holds the place where the words part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import Workspace, as_bytes, slices

#: Different words that a task counts before it sends them; rows of a bucket beyond which it is dealt anew.
HELD, MOST = 1 << 18, 1 << 14
#: Parts of a word in which an edit is sought.
PARTS = 4

# Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, lower-cased bytes.
_LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, slip: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z lower-cased) of `least` or more code points, and how often they occur.

    slip: a change of a document's runs, given a run and the CRC-32 of the document's key and a colon. Null and empty texts have no words.
    Counts are added up in a task before they are shuffled.
    """
    runs = re.compile(_LETTER + b"{%d,}" % least)

    def send(seen: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in seen.items() if len(w) - w.count(b"\xc3") >= least}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not t:
                    continue
                own = Counter(runs.findall(t.lower()))
                if slip is None:
                    seen.update(own)
                    continue
                start = zlib.crc32(b"%s:" % name.encode())
                for w, n in own.items():
                    seen[slip(w, start)] += n
            if len(seen) >= HELD:
                yield send(seen)
                seen = Counter()
        yield send(seen)

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name"), as_bytes(text).alias("bytes"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """Pairs of places in a sorted list of distinct words that are one inserted, deleted or replaced character apart, and where they part."""
    place = {w: i for i, w in enumerate(words)}
    nodes = [(0, len(words))]
    while nodes:
        low, high = nodes.pop()
        if high - low < 2:
            continue
        d = len(commonprefix([words[low], words[high - 1]]))
        ends_here = low if len(words[low]) == d else None
        children, start = [], low if ends_here is None else low + 1
        for i in range(start + 1, high + 1):
            if i == high or words[i][d] != words[start][d]:
                children.append((start, i))
                start = i
        nodes += children
        heavy = max(children, key=lambda c: c[1] - c[0])
        head, sign = words[low][:d], words[heavy[0]][d]
        if ends_here is not None and (longer := place.get(head + sign)) is not None:
            yield ends_here, longer, d
        merged: dict[str, list[int]] = {}  # light subtrees without their first characters
        for child in children:
            if child is heavy:
                continue
            for i in range(*child):
                w = words[i]
                rest = w[d + 1 :]
                others = merged.setdefault(rest, [])
                for j in others:
                    yield j, i, d
                others.append(i)
                if (j := place.get(head + sign + rest)) is not None:  # replaced
                    yield i, j, d
                if rest[:1] != w[d] and (j := place.get(head + rest)) is not None:  # skipped
                    yield i, j, d
                if (j := place.get(head + sign + w[d:])) is not None:  # the heavy path's character skipped
                    yield i, j, d


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by sorting. Spark goes by the compressed size of files and counts rows before they explode, so it would broadcast tables that grow with the words."""
    return left.hint("merge").join(right.hint("merge"), key, how)


def _dealt(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with windows (start, stop) of the m characters as buckets: keyed by what lies outside; those of one row are left out."""
    keyed = windows.withColumn("bucket", F.xxhash64("m", "start", "stop", F.expr("substring(word, 1, start)"), F.expr("right(word, m - stop)")))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return _merged(keyed, sizes, "bucket")


def _quarters(rows: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows with a window for each part of [start, stop) that isn't empty."""
    cut = lambda j: F.expr(f"cast({start} as int) + cast(floor(({stop} - {start}) * {j} / {PARTS}) as int)")
    windows = F.array(*[F.struct(cut(j).alias("start"), cut(j + 1).alias("stop")) for j in range(PARTS)])
    rest = [c for c in rows.columns if c not in ("start", "stop", "bucket", "size")]
    return rows.select(*rest, F.explode(F.filter(windows, lambda w: w["stop"] > w["start"])).alias("w")).select(*rest, "w.start", "w.stop")


def _near(rows: DataFrame) -> DataFrame:
    """word, near, near_n, both ways, of the pairs of each bucket."""

    def pairs(part: pa.Table) -> Iterator[tuple[str, str, int]]:
        keys = np.stack([part.column(c).to_numpy() for c in ("bucket", "m", "start", "stop")])
        edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
        words, counts = part.column("word").to_pylist(), part.column("n").to_pylist()
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if high - low < 2:
                continue
            order = sorted(range(low, high), key=words.__getitem__)
            m, start, stop = keys[1:, low].tolist()
            stop += stop == m  # the shorter word may be the longer one's beginning
            for i, j, d in near_pairs([words[k] for k in order]):
                a, b = order[i], order[j]
                if start <= d < stop and min(len(words[a]), len(words[b])) == m:
                    yield words[a], words[b], counts[b]
                    yield words[b], words[a], counts[a]

    def told(part: pa.Table) -> Iterator[pa.RecordBatch]:
        held = []
        for row in pairs(part):
            held.append(row)
            if len(held) >= 1 << 16:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list[tuple[str, str, int]]) -> pa.RecordBatch:
        word, near, n = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(near), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket's rows, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            buckets = b.column(0).to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if held and (cut or held[-1].column(0)[-1].as_py() != buckets[0]):
                yield from told(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from told(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from told(pa.Table.from_batches(held))

    sorted_rows = rows.select("bucket", "m", "start", "stop", "word", "n").repartition("bucket").sortWithinPartitions("bucket", "m", "start", "stop")
    return sorted_rows.mapInArrow(run, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = 10, least: int = 7) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n) of `least` or more code points, at least four.

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n (ties: the smallest), if that is
    `times` the word's n or more, else null; root: where the forms lead, the word itself without one. Null words have no row, words that are too
    short neither. An empty table has no rows.
    """
    work = Workspace(words.sparkSession, "spelling")
    known = work.keep(words.select("word", "n").filter(F.length("word") >= max(least, PARTS)))
    length = F.length("word")
    by_length = known.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least)).alias("m"))
    rows = work.keep(_dealt(by_length, _quarters(by_length, "0", "m")))
    near = []
    while True:
        near.append(work.keep(_near(rows.filter(f"size <= {MOST} or stop - start = 1"))))
        hot = rows.filter(f"size > {MOST} and stop - start > 1")
        if not hot.head(1):
            break
        rows = work.keep(_dealt(hot, _quarters(hot, "start", "stop")))
    every = near[0]
    for more in near[1:]:
        every = every.unionByName(more)
    best = every.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= times * F.col("n")
    out = _merged(known, best, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"))
    out = work.keep(out)
    step = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the way
        further = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = work.keep(_merged(step, further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not step.filter("moved").head(1):
            break
        step = step.drop("moved")
    work.finish(out, work.kept[work.count])
    return _merged(out, step.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
