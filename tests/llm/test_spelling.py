"""Spelling variants against all pairs, and the cases of the contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from factlake.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=10):
    """(word, form, root, n, n_near, form_n) of a dict of words and counts, by comparing all pairs."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def made(seed, size, letters, lengths):
    rnd, words = random.Random(seed), set()
    while len(words) < size:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(lengths)))
        words.add(w)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]]))
    return {w: rnd.choice([1, 1, 2, 3, 10, 11, 20, 100, 300, 5000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("seed", range(12))
def test_trie_finds_each_pair_where_it_parts(seed):
    words = sorted(made(seed, 150, "ab" if seed % 2 else "abcdé", [7, 8, 9, 12]))
    got = [(*sorted((i, j)), d) for i, j, d in spelling.near_pairs(words)]
    want = {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}
    assert len(got) == len(want) and {x[:2] for x in got} == want
    assert all(words[i][:d] == words[j][:d] and words[i][d : d + 1] != words[j][d : d + 1] for i, j, d in got)


@pytest.mark.parametrize("most", [spelling.MOST, 3])  # 3: nearly all buckets are dealt anew
@pytest.mark.parametrize("letters", ["ab", "abcdefgé"])
def test_against_all_pairs(spark, monkeypatch, most, letters):
    monkeypatch.setattr(spelling, "MOST", most)
    counts = made(1, 500, letters, [7, 7, 8, 9, 10, 13, 40]) | {"x" * 5000: 50, "x" * 4999: 500, "y" + "x" * 4999: 3, "abcdefg": 1}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain(counts)


def test_chains_of_forms_short_and_null_words(spark):
    counts = {"aaaaaaaaaa": 10**9, "aaaaaaaaab": 10**7, "aaaaaaaacb": 10**5, "aaaaaaadcb": 10**3, "aaaaaaedcb": 10, "short": 3, "": 1, None: 7}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: "aaaaaaaaaa" for w in counts if w and len(w) > 7}


def test_no_table_that_grows_with_the_words_is_broadcast(spark, monkeypatch):
    # A file of words compressed below Spark's threshold explodes to many more rows, which a broadcast would send through the driver.
    kept, plans = spelling.Workspace.keep, []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling.Workspace, "keep", lambda self, df: (told(df), kept(self, df))[1])
    out = spelling.variants(spark.createDataFrame(list(made(1, 100, "ab", [7, 8]).items()), "word string, n long"))
    told(out)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1" and len(plans) > 4
    assert [p for p in plans if "Broadcast" in p] == []


def test_op11(spark, tmp_path):
    rnd = random.Random(4)
    words = ["Example", "exampLe", "examplé", "ÀÉÎÕÜßÿ", "àéîõüßÿ", "short", "longerword", "longerwords", "x" * 900, "a×b÷cdefgh", "中文example", "under_scores", "abcdefg1hijklmno"]
    texts = [None, "", " ", "…example…examplé"] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(400)] + ["samehotword " * 50] * 200
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    got = queries.op11_spelling(spark, str(tmp_path)).collect()
    assert len(got) > 20 and {tuple(r) for r in got} == plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def test_op11_on_the_given_tables(spark):
    """Over the whole smallest table, in which every 31st word of a text has a slip."""
    counts = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert {tuple(r) for r in queries.op11_spelling(spark, "/root/testdata/sf0.001").collect()} == plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def test_counting_without_slips_sends_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    df = spark.createDataFrame([(None, "letters Letters LETTERS ünïcödé"), (1, "letters alphabet"), (1, None)], "doc_id long, text string").repartition(1)
    assert {tuple(r) for r in spelling.count_words(df).collect()} == {("letters", 4), ("ünïcödé", 1), ("alphabet", 1)}
