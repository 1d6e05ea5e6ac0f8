"""Phrases against a plain version, the perfect hash, and the cases of the contract."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import collocations, queries


def plain(docs, least=30, longest=4, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    out = {}
    for (lang, *p), a in often.items():
        if any(100 * b >= 80 * a for o, b in often.items() if o[0] == lang and len(o) > len(p) + 1 and any(list(o[i : i + len(p)]) == p for i in range(1, len(o) - len(p) + 1))):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("seed", range(10))
def test_perfect_hash(seed):
    """All keys have different slots from 0 on, over all shards together; other keys have none."""
    rnd = np.random.default_rng(seed)
    keys = np.unique(rnd.integers(0, 1 << 64, [1, 2, 5, 100, 3000, 40000][seed % 6], dtype=np.uint64))
    rnd.shuffle(keys)
    shard = keys >> np.uint64(61)
    shards = [(int(s), *collocations.perfect_hash(keys[shard == s])) for s in np.unique(shard)]
    table = collocations.Slots([(s, sizes, bits, placed.tobytes(), placed.view(np.int64).tobytes()) for s, sizes, bits, placed in shards], 3)
    slots = table.of(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    assert (table.of(keys ^ np.uint64(1 << 20)) == -1).sum() >= len(keys) - np.isin(keys ^ np.uint64(1 << 20), keys).sum()


def table():
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(25)] + ["Ünï", "中文", "A", "a", "B-b", "'s", "x y", "é" * 40, "z" * 200]
    phrases = ["new york city hall", "of the", "on the other hand", "de facto", "alpha beta gamma", "a a a"]
    texts = [None, "", " \t ", "...", "new york", "one.two three\nfour"]
    for _ in range(700):
        words = [rnd.choice(phrases) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        texts.append("".join(w + rnd.choice([" ", " ", " ", "  ", "\t", " \t", ", ", ". ", "\n", "\r\n", "\x0b", "!", "? ", "; ", ":", "\x1c "]) for w in words))
    texts += ["same hot line of words"] * 300 + ["again and again " * 9000]
    return [(i, t, rnd.choice(["en", "en", "en", "fr", None, "und", ""])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    """Also where texts are cut in many blocks, candidates take several passes, and counts are sent often and joined."""
    if small:
        for name, value in {"BLOCK": 300, "HELD": 200, "SLOTS": 60, "SHARD": 16, "FAN": 2, "FEW_COUNTS": 1, "PARTS": 3}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = collocations.phrases(df).collect()
    want = plain([r[1:] for r in rows])
    assert len(got) == len(want) > 30 and {tuple(r) for r in got} == want
    assert {tuple(r) for r in collocations.phrases(df, least=60, longest=3, top=5).collect()} == plain([r[1:] for r in rows], 60, 3, 5)


def test_long_pieces_cut_between_words():
    """A text cut anywhere has the phrases of the whole."""
    for block in (1, 2, 7, 40):
        text = b"aa b  ccc\tdddd e ff, g h i jj kkk l mm n oo p q r s"
        old, collocations.BLOCK = collocations.BLOCK, block
        try:
            chunks = [(c, n, 0) for c, n in collocations._chunks(text, 3)]
        finally:
            collocations.BLOCK = old
        found = []
        for c in chunks:
            b = collocations.Block([c], np.zeros(1, np.uint64))
            found += [b.phrase(int(i), n) for n in (1, 2, 3, 4) for i in np.flatnonzero(b.whole(n))]
        want = [" ".join(w[i : i + n]) for w in (p.split() for p in text.decode().split(",")) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
        assert sorted(found) == sorted(want)


def test_null_keys_and_other_columns(spark):
    df = spark.createDataFrame([(None, "big apple pie", None)] * 40 + [(3, "big apple", "en")] * 10, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("group", F.lit(3))
    assert [tuple(r) for r in collocations.phrases(df).collect()] == [("und", 1, "big apple pie", 40, 40, 40, 120, 1000000)]


def test_op12_on_the_given_tables(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op12_phrases(spark, "/root/testdata/sf0.001").collect()} == plain(docs)
