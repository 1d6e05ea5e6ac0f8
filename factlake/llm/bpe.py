"""Exact byte-level BPE encoding and decoding of published tokenizer files.

Encoding backtracks: an Aho-Corasick automaton finds the longest token at every position, a table of compatible pairs says
whether two tokens may stand side by side in the output of BPE, and a token that leads nowhere gives way to the longest token
that is its prefix. The first path that reaches the end is the one that merging would give; dead positions are remembered, so
the work is linear in the text (published with the public Rust crate `bpe`). Decoding gathers bytes by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import slices

#: Pre-tokens whose ids a worker remembers before it starts afresh, and the length from which on it remembers none.
PIECE_CACHE, PIECE_CHARS = 1 << 17, 64
_PAIR_CACHE = 1 << 18

# Letters and digits of Unicode 16, which the library knows and Python's tables (15.1) don't.
LATER_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
LATER_DIGITS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
# White space as Unicode defines it.
SPACES = "\t-\r \x85\xa0  -     　"


# Fixed value: what cuts a text into pre-tokens, in the notation of tiktoken's regular expressions.
MERGED = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEPARATORS, _WHOLE = set("\x1c\x1d\x1e\x1f"), 1 << 20


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What cuts any text into pre-tokens; the same by Python's own classes; what a text must not hold for the latter."""

    def among(initial: str, later: str) -> str:
        found, begin = [], None
        for c in range(0x110001):
            inside = c < 0x110000 and not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] == initial
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                found.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
                begin = None
        for x in later.split():
            a, _, b = x.partition("-")
            found.append(f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}")
        return "".join(found)

    letter, digit = among("L", LATER_LETTERS), among("N", LATER_DIGITS)
    exact = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{SPACES}{letter}{digit}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    quick = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    unlike = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ]")
    return exact, quick, unlike


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """The tables of a byte-level BPE file. Tokens are numbered here by the time of their merge; `ids` has the file's ids."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("added tokens must match as they stand")
        letters, vocab = byte_letters(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = sorted((x for x in letters if x in vocab), key=letters.get)
        self.left, self.right = list(range(len(names))), list(range(len(names)))
        number = {x: i for i, x in enumerate(names)}
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            self.pair.setdefault((number[a], number[b]), len(names))
            if a + b in number:
                raise ValueError("two merges make one token")
            number[a + b] = len(names)
            names.append(a + b)
            self.left.append(number[a])
            self.right.append(number[b])
        self.pieces = [bytes(letters[c] for c in x) for x in names]
        self.ids = [vocab[x] for x in names]
        self.coded = [i.to_bytes(4, "little") for i in self.ids]
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        known = {p: i for i, p in enumerate(self.pieces)}
        self.shorter = [next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1) for p in self.pieces]
        self.sizes = [len(p) for p in self.pieces]
        self.most = max(self.sizes)
        self._compatible: dict[tuple[int, int], bool] = {}
        self._automaton, self._fast, self._codes = None, {}, np.array(self.ids, "<u4")
        # For decoding: each id's bytes within one string of bytes.
        entries = {**dict(zip(self.ids, self.pieces, strict=True)), **{i: self._special_bytes(s, letters) for s, i in self.special.items()}}
        top = max(entries) + 1
        self.lengths = np.array([len(entries.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(entries.get(i, b"") for i in range(top)), np.uint8)

    @staticmethod
    def _special_bytes(content: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in content) if all(c in letters for c in content) else content.encode()

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                self._automaton.add_word(p.decode("latin-1"), i)
            self._automaton.make_automaton()
        return self._automaton

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends with just a, then b: no earlier merge may reach across the seam."""
        key = (a, b)
        known = self._compatible.get(key)
        if known is not None:
            return known
        if len(self._compatible) >= _PAIR_CACHE:
            self._compatible.clear()
        pair, left, right = self.pair, self.left, self.right
        latest, good = len(left) + 1, None
        while good is None:
            merged = pair.get((a, b))
            if merged is not None and merged < latest:
                good = False
            elif a > b:  # what was merged last is taken apart first
                latest, a = a, right[a]
                if a == latest:
                    latest, b = b + 1, left[b]
                    good = True if b + 1 == latest else None
            else:
                latest, b = b + 1, left[b]
                if b + 1 == latest:
                    latest, a = a, right[a]
                    good = True if a == latest else None
        self._compatible[key] = good
        return good

    def encode_piece(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        data = piece.encode()
        text, sizes, most, seams = data.decode("latin-1"), self.sizes, self.most, self._compatible
        find, path, dead, at, last = self.automaton.iter_long, [], set(), 0, -1
        greedy = find(text)  # the longest tokens one after another, which serve until two of them don't go together
        token = next(greedy)[1] if data else -1
        while at < len(data):
            end = at + sizes[token]
            good = end not in dead
            if good and path:
                good = seams.get((last, token))
                if good is None:
                    good = self.compatible(last, token)
            if good:
                path.append(token)
                last, at = token, end
                if at < len(data):
                    token = next(greedy or find(text[at : at + most]))[1]
                continue
            greedy, token = None, self.shorter[token]
            if token < 0:
                dead.add(at)
                token = path.pop()
                at -= sizes[token]
                last = path[-1] if path else -1
        return b"".join([self.coded[t] for t in path])

    def merge_piece(self, piece: str) -> bytes:
        """The same by tiktoken's merge loop, faster for short pre-tokens. Long ones would take it quadratic time."""
        if len(piece) > 256:
            return self.encode_piece(piece)
        coded = self.coded
        return b"".join([coded[t] for t in self._merged(r"[\s\S]+")(piece)])

    def _merged(self, pattern: str) -> Callable[[str], list[int]]:
        """tiktoken's encoder of what a pattern cuts a text into; tokens as they are numbered here."""
        if pattern not in self._fast:
            import tiktoken

            self._fast[pattern] = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(self.pieces)}, special_tokens={}).encode_ordinary
        return self._fast[pattern]

    def merge_text(self, text: str, known: Pieces) -> bytes:
        """Little-endian 32-bit ids of a whole text, special strings included. Parts of up to _WHOLE characters, in
        letters that every table of classes knows, go through tiktoken at once, others by pre-tokens."""
        unlike, out = patterns()[2], []
        for special, x in self.cut_text(text):
            if special:
                out.append(self.special[x].to_bytes(4, "little"))
            elif len(x) <= _WHOLE and (not unlike.search(x) if not x.isascii() else _SEPARATORS.isdisjoint(x)):
                out.append(self._codes[self._merged(MERGED)(x)].tobytes())
            else:
                out.append(b"".join(map(known.__getitem__, split(x))))
        return b"".join(out)

    def cut_text(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special strings (True), and what stands between them."""
        if self.cut is None or not any(s in text for s in self.special):
            yield False, text
        else:
            for i, x in enumerate(self.cut.split(text)):
                if x:
                    yield bool(i % 2), x

    def encode(self, text: str, known: Pieces) -> bytes:
        return b"".join(self.special[x].to_bytes(4, "little") if special else b"".join(map(known.__getitem__, split(x))) for special, x in self.cut_text(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids; unknown ids have none."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[where].tobytes()


def split(text: str) -> list[str]:
    exact, quick, unlike = patterns()
    return (exact if unlike.search(text) else quick).findall(text)


class Pieces(dict):
    """Ids of pre-tokens, remembered for a bounded number of short ones."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECE_CACHE:
                self.clear()
            self[piece] = out
        return out


_MODELS: dict[bytes, Model] = {}
_PIECES: dict[tuple[bytes, bool], Pieces] = {}


def model(raw: bytes) -> Model:
    """Built once in each worker."""
    key = hashlib.sha1(raw).digest()
    if key not in _MODELS:
        _MODELS[key] = Model(raw)
    return _MODELS[key]


def pieces(raw: bytes, fast: bool = False) -> Pieces:
    """The worker's known pre-tokens, which its tasks share."""
    key = (hashlib.sha1(raw).digest(), fast)
    if key not in _PIECES:
        m = model(raw)
        _PIECES[key] = Pieces(m.merge_piece if fast else m.encode_piece)
    return _PIECES[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file (a few MB, whatever the corpus) for the workers, who may not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(df: DataFrame, column: str, name: str, kind: T.DataType, convert: Callable[[Iterator], Iterator]) -> DataFrame:
    """df with a further column that `convert` makes of another; a column of that name is replaced."""
    rest = [c for c in df.columns if c != name]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(column).alias("value"))
    schema = T.StructType([source.schema["rest"], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), convert(part.column(1))], names=["rest", name])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], name)


def _ids_of(m: Model, known: Pieces, texts: pa.Array) -> pa.ListArray:
    coded = [m.encode(t, known) if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))


def _texts_of(m: Model, rows: pa.ListArray) -> pa.Array:
    return pa.array([m.decode(np.array([i for i in r.values.to_pylist() if i is not None] if r.values.null_count else r.values.to_numpy(), np.int64)).decode("utf-8", "replace") if r.is_valid and len(r.values) else "" for r in rows], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of each text, as the tokenizers library gives them with add_special_tokens=False.

    Null and empty texts have no ids. Texts of any length are encoded whole. A column named `ids` is replaced. No shuffle.
    """
    raw = vocabulary(df.sparkSession, path)
    return _map(df, text, ids, T.ArrayType(T.IntegerType()), lambda texts: _ids_of(model(raw.value), pieces(raw.value), texts))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each row's ids, special tokens included; null ids and null arrays have none. No shuffle."""
    raw = vocabulary(df.sparkSession, path)
    return _map(df, ids, text, T.StringType(), lambda rows: _texts_of(model(raw.value), rows))


def transcode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode(), then decode() of what it gives, in one pass with one copy of the tables; columns of both names are replaced."""
    raw = vocabulary(df.sparkSession, path)
    both = next(f"both{i}" for i in range(len(df.columns) + 1) if f"both{i}" not in df.columns)

    def convert(texts: pa.Array) -> pa.StructArray:
        m = model(raw.value)
        found = _ids_of(m, pieces(raw.value), texts)
        return pa.StructArray.from_arrays([found, _texts_of(m, found)], names=["ids", "decoded"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    out = _map(df, text, both, kind, convert)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    return out.select(*rest, F.col(f"{both}.ids").alias(ids), F.col(f"{both}.decoded").alias(decoded))
