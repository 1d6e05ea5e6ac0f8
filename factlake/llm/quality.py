"""Quality rules by repetition coverage.

The method: rolling hashes of several n-gram lengths measure, in numpy, which share of a text's characters lies inside
duplicated n-grams, and which share inside duplicated lines. A text fails if one share exceeds its limit. The limits are
those published for large web corpora (Rae et al. 2021, table A1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import as_bytes, hash_words, mix, rolling, slices

# N-gram length and the largest share of characters inside n-grams of that length seen before in the text.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The largest share of characters inside lines that repeat an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, ngram_share double, base_failed boolean, kept boolean"
_NOT_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


def _chars(t: bytes) -> int:
    """Code points outside white space."""
    return len(t.translate(None, _NOT_CONTINUATION + _SPACE))


def _dup_lines(t: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their code points."""
    seen, n, chars = set(), 0, 0
    if b"\n" in t:
        for line in t.split(b"\n"):
            if line in seen:
                n += 1
                chars += _chars(line)
            elif line.strip(_SPACE):
                seen.add(line)
    return n, chars


def _cover(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside windows of n words that begin at these positions."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the n-word windows that stay inside one text; a key holds its text too."""
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    with np.errstate(over="ignore"):
        return at, mix(rolling(words, n)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    words, offsets = hash_words(texts)
    size, docs = len(words), len(texts)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    per = lambda mask, w=None: np.bincount(doc[mask], None if w is None else w[mask], docs)
    lengths = np.fromiter((len(w.translate(None, _NOT_CONTINUATION)) for t in texts if t for w in t.split()), np.float64, size)
    n_words, chars = np.diff(offsets), per(slice(None), lengths)
    out = {"n_words": n_words, "word_chars": chars.astype(np.int64), "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], np.int64)}

    at, keys = _windows(words, doc, 3)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    out["n_repeat_words"] = per(_cover(twice, 3, size)).astype(np.int64)

    lines = [_dup_lines(t) if t else (0, 0) for t in texts]
    out["n_dup_lines"] = np.array([x[0] for x in lines], np.int64)
    out["line_share"] = np.array([x[1] for x in lines]) / np.maximum(chars, 1)

    worst = np.zeros(docs)
    excess = np.zeros(docs, bool)
    # A longer n-gram can repeat only where its first five words repeat, so only those positions are looked at again.
    alive = None
    for n, limit in NGRAM_LIMITS.items():
        at, keys = _windows(words, doc, n)
        if alive is not None:
            hold = alive[at]
            at, keys = at[hold], keys[hold]
        _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        again = np.ones(len(at), bool)
        again[first] = False
        share = per(_cover(at[again], n, size), lengths) / np.maximum(chars, 1)
        worst, excess = np.maximum(worst, share), excess | (share > limit)
        alive = np.zeros(size, bool)
        alive[at[counts[inverse] > 1]] = True
    out["ngram_share"] = worst
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    out["kept"] = ~(out["base_failed"] | excess | (out["line_share"] > LINE_LIMIT))
    return out


def score_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` with the measures and the verdict of each text (COLUMNS); columns of those names are replaced.

    Null and empty texts have no words, so they fail. Long texts are read whole. Rows are independent of each other:
    repeated rows get equal verdicts, an empty table stays empty. No shuffle.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    rest = [c for c in docs.columns if c not in names]
    # The first column is a placeholder, as slices() cuts by the second.
    source = docs.select(F.lit(0).alias("__row"), as_bytes(text).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measure(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(2), *(pa.array(found[n]) for n in names)], names=["__rest", *names])

    schema = T.StructType([source.schema["__rest"], *(T.StructField(n, T.DoubleType() if k == "double" else T.BooleanType() if k == "boolean" else T.LongType()) for n, k in (x.split() for x in COLUMNS.split(", ")))])
    out = source.mapInArrow(run, schema) if rest else source.mapInArrow(lambda it: (pa.RecordBatch.from_arrays(list(b.columns)[1:], names=names) for b in run(it)), COLUMNS)
    return out.select(*([F.col(f"__rest.`{c}`").alias(c) for c in rest]), *names)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns of `docs`, whatever their names. Null and empty texts fail; repeated rows pass or fail together; an
    empty table stays empty."""
    scored = score_quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__t")), "__t")
    return scored.filter("kept").select("__doc.*")
