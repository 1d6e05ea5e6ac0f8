"""Steps where queries go to the rows, against the plain joins, and how many rows leave them."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import blocks, evaluation, index
from factlake.operators import retrieval as R

FACTS = "ord long, id string, scope string, name string, data string, created_at timestamp"


@pytest.mark.parametrize("products", [blocks.PRODUCTS, 1])
def test_nearest_by_blocks_equals_the_join(spark, monkeypatch, products):
    """Copies, zero, null, short and NaN vectors, and a query without a vector."""
    monkeypatch.setattr(blocks, "PRODUCTS", products)
    rnd = random.Random(4)
    pool = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(12)] + [[0.0] * 5, None, [1.0], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 4]
    own = [rnd.choice(pool[:12] if i % 4 else pool) for i in range(160)]
    facts = spark.createDataFrame([(i, str(i), rnd.choice(["en", "fr"]), None, "x", None) for i in range(160)] + [(200, "200", "de", None, "x", None)], FACTS)
    vectors = spark.createDataFrame([(str(i), v) for i, v in enumerate(own)] + [("200", pool[0])], "fact_id string, vector array<double>")
    asked = spark.createDataFrame([(i, v, ["en", "fr", "de"]) for i, v in enumerate(pool)], "query_id long, vector array<double>, scopes array<string>")
    found = lambda: sorted((r.query_id, r.scope, r.id, repr(r.score)) for r in R.vector_leg(asked, facts, vectors, 5).collect())
    got = found()
    monkeypatch.setattr(R, "FEW_BYTES", -1)
    assert got == found() and len(got) == len(pool) * 11


def test_a_task_gives_on_the_best_of_its_texts(spark):
    rows = spark.createDataFrame([(str(i), "en" if i % 3 else None, "alpha beta" if i % 2 else "alphabet", i % 7) for i in range(300)], "id string, scope string, data string, at int").coalesce(1)
    asked = spark.createDataFrame([(1, "en", ["alpha", "beta"]), (2, "en", ["bet"])], "query_id long, scope string, tokens array<string>")
    got = index.scores(rows, ["scope", "id", "at"], {"data": 1}, asked, best=(4, {"at": True, "id": False})).collect()
    assert len(got) == 16
    best = lambda keep: sorted((str(i) for i in range(300) if keep(i)), key=lambda i: (-(int(i) % 7), i))[:4]
    assert sorted(r.id for r in got if r.query_id == 1 and r.scope == "en") == sorted(best(lambda i: i % 3 and i % 2))
    assert sorted(r.id for r in got if r.query_id == 2 and r.scope is None) == sorted(best(lambda i: i % 3 == 0))


def test_facts_that_hold_a_text(spark):
    texts = ["", "é", "abc", "ab", "the whole passage is long", "passage is long, longer", None]
    facts = [(str(i), ["en", "fr", None][i % 3], t) for i, t in enumerate([*texts, "x the whole passage is long, longer é abc", "abcab", "é", "the whole passage is short"] * 3)]
    asked = [(q, s, t) for q, t in enumerate(texts) for s in ("en", "fr")]
    got = blocks.holding(spark.createDataFrame(facts, "id string, scope string, data string"), spark.createDataFrame(asked, "query_id long, scope string, query string")).collect()
    assert sorted((r.query_id, r.key) for r in got) == sorted((q, i) for q, s, t in asked for i, own, d in facts if own == s and t is not None and d is not None and t in d)


def test_outcomes_read_a_ranking_once(spark):
    gold = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "query_id long, class string")
    hits = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 7, 0.4), (2, "z", 1, 0.3)], "query_id long, key string, rank long, score double").filter(F.col("rank") + 0 < 99)
    out = evaluation.outcomes(gold, spark.createDataFrame([(1, "b"), (1, "y"), (1, "a"), (3, "q")], "query_id long, key string"), hits)
    assert {r.query_id: (r.n_expected, r.p5, r.r10, r.rr, r.hit, r.raw_hits, r.top_score) for r in out.collect()} == {1: (3, 0.2, 2 / 3, 1.0, True, 2, 0.5), 2: (0, 0.0, None, 0.0, False, 1, 0.3), 3: (1, 0.0, 0.0, 0.0, False, 0, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("< 99") == 1
