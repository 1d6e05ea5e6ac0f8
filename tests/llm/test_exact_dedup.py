"""Exact duplicates against a plain version, the fingerprints' code, and the cases of the contract."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import exact_dedup


def plain(docs):
    """(doc_id, keep_id, group_size, kept, sha256) of rows (doc_id, text) with different ids."""
    bare = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in docs}
    size = {i: len(t or "") for i, t in docs}
    groups = {}
    for i in sorted(bare, key=lambda i: (-size[i], i)):
        groups.setdefault(bare[i], []).append(i)
    return {(i, g[0], len(g), i == g[0], brute.sha(t)) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("seed", range(40))
def test_codes_give_the_numbers_back(seed):
    rnd = np.random.default_rng(seed)
    values = np.sort(rnd.integers(0, 1 << int(rnd.integers(1, 60)), int(rnd.integers(1, 3000)), dtype=np.uint64))
    if seed % 3 == 0:
        values = np.sort(np.concatenate([values, values[: len(values) // 2]]))
    assert (exact_dedup.golomb_back(len(values), *exact_dedup.golomb(values)) == values).all()
    if seed > 30:  # close to what the differences' entropy needs
        assert len(b"".join(exact_dedup.golomb(values)[1:])) * 8 <= len(values) * (np.log2(max(2, float(values[-1]) / len(values))) + 4) + 64


def table():
    rnd = random.Random(11)
    texts = [None, "", " \n\t\x0b\x0c\r ", "a b", "ab", "a b", "a b ", "ab\x1f", "é", "é", "é ", "long " * 60_000, "long" * 60_000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    texts += ["one hot text"] * 300 + ["one  hot text"] * 30 + [f"alone {i}" for i in range(300)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("spare", [exact_dedup.SPARE, -9])  # -9: 6 bits, so that most texts are suspects
def test_against_plain(spark, spare, monkeypatch):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    if spare < 0:
        monkeypatch.setattr(exact_dedup, "HELD", 50)
    got = exact_dedup.groups(df, spare=spare).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == plain(rows)


def test_null_keys_repeated_rows_and_names(spark):
    """A null key comes last; of rows that are equal in all, one stays; columns of any name come through."""
    rows = [(None, "a b", 1), (5, "ab", 2), (5, "a b", 3), (5, "a b", 3), (7, "a b", 4), (None, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").select("doc_id", "text", F.col("n").alias("a.b"), F.lit(1).alias("sha"), F.lit(2).alias("my col"), F.lit(3).alias("kept"))
    out = exact_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(5, "a b", 3, 1, 2, 3), (None, "z", 5, 1, 2, 3)]
    assert sorted((r.group_size, r.kept) for r in exact_dedup.groups(df).collect()) == [(1, True)] + [(5, False)] * 4 + [(5, True)]


def test_only_suspects_are_shuffled(spark, monkeypatch):
    """Without copies no text is a suspect, but for a few whose cells collide."""
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(5000)], "doc_id long, text string").repartition(4)
    kept = []
    real = exact_dedup.Workspace.keep
    monkeypatch.setattr(exact_dedup.Workspace, "keep", lambda self, *a: kept.append(real(self, *a)) or kept[-1])
    assert exact_dedup.groups(df).filter("kept and group_size = 1").count() == 5000
    assert kept[0].filter("bare is not null").count() < 10
