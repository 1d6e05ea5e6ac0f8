"""Every query of the catalogue against DuckDB over the same tables, and the fusion against hand-made cases."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from factlake.functions import text as T
from factlake.operators import retrieval as R
from factlake.plans import catalogue, engine, store, writing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


QUERIES = catalogue.queries() | store.queries() | engine.queries() | writing.queries()
SQL = catalogue.oracle_sql() | store.oracle_sql() | engine.oracle_sql() | writing.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = sorted(got.columns)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in order) for r in cur.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want and want


def leg(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "query_id int, ord int, id string, link_id string, data string, score double")


def fused(spark, cos, lex, **options):
    return [(r.key, round(r.score, 9)) for r in R.fuse(leg(spark, cos), leg(spark, lex), **options).orderBy("rank").collect()]


def test_fusion_by_link_text_and_bar(spark):
    a = 1 / 61
    assert fused(spark, [("canon", None, "x", 0.6)], [("file", "canon", "other", 0.9)]) == [("canon", round(2 * a, 9))]
    assert fused(spark, [("pg", None, "nuqs over state", 0.6)], [("f", None, "  nuqs over   state ", 0.9)]) == [("pg", round(2 * a, 9))]
    assert fused(spark, [], [("file", "absent", "t", 0.8)]) == [("absent", round(a, 9))]
    assert fused(spark, [("a", None, "ta", 0.9)], [("b", None, "ta", 0.01)]) == [("a", round(a, 9))]
    assert fused(spark, [("p", None, "tp", 0.9), ("e", None, "te", 0.8)], [("z", None, "te", 0.9), ("y", None, "", 0.9)], gated=True) == [("e", round(1 / 62 + a, 9)), ("p", round(a, 9))]


def test_tokens(spark):
    cases = {"The EMBED embed of a x!": ["the", "embed", "of"], "pg ui x": ["pg", "ui"], "PAPER_MEM_TIMEOUT op-deadline": ["paper_mem_timeout", "op-deadline", "paper", "mem", "timeout", "op", "deadline"], "a b ??": [], "été": []}
    rows = spark.createDataFrame(list(cases.items()), "q string, want array<string>").select(T.lexical_tokens(T.F.col("q")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_diverse_against_brute_force(spark):
    from factlake.operators import rerank

    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else ({t} if t else set())

    rows = [(q, f"k{i}", d, s, i + 1) for q in (1, 2) for i, (d, s) in enumerate([("alpha beta", 0.9), ("alpha beta", 0.9), ("gamma delta", 0.5 * q), ("alpha betas", 0.4), ("", None), ("zz", 0.1)])]
    for weight in (0.0, 0.3, 0.7):
        want = {}
        for q in (1, 2):
            left, taken = [r for r in rows if r[0] == q], []
            best = max([0.0, *(r[3] or 0.0 for r in left)]) or 1.0
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
            while left:
                pick = max(left, key=lambda r: (weight * (r[3] or 0.0) / best - (1 - weight) * max([0.0, *(like(grams(r[2]), grams(x[2])) for x in taken)]), -r[4]))
                left.remove(pick)
                taken.append(pick)
                want[q, pick[1]] = len(taken)
        got = rerank.diverse(spark.createDataFrame(rows, "query_id int, key string, data string, score double, rank int"), weight)
        assert {(r.query_id, r.key): r.rank for r in got.collect()} == want


def test_entity_gate(spark):
    from factlake.functions import entities

    cases = {"the one-liner in the folder": False, "just before end of": True, "embed job stalled and": True, "so the re": True, "": True, "gate": True, "release gate": False, "the fleet's release gate": True, "user's guide": False, "a genuine removal reds": True, "the current release gate": False, "embedding model": False, "removing models": True, "a|b cd": True, None: True}
    rows = spark.createDataFrame(list(cases.items()), "e string, want boolean").select(entities.low_quality(T.F.col("e")).alias("got"), "want", "e").collect()
    assert [r.e for r in rows if r.got != r.want] == []


def test_topic_slug_of_the_whole_text(spark, tmp_path):
    """Words count wherever they stand: after 200 signs, and one that begins before and ends after them."""
    texts = ["!" * 300 + " One two", "x" * 250 + " y", "中" * 400]
    rows = [(i, t, "src", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.slug for r in store.queries()["topic_slug"](spark, str(tmp_path)).collect()}
    assert got == {"0": "one_two", "1": "x" * 250 + "_y", "2": "memory"}
