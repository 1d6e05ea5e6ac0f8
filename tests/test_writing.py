"""Cases of the write path that the registered queries don't reach: nulls, empty tables, errors."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import embedding as M
from factlake.operators import writing as W


def test_temporal_controls():
    assert W.temporal_controls(None) == (None, False, {})
    assert W.temporal_controls({"as_of": "2024-01-20T12:00:00", "include_superseded": "true", "kind": "user"}) == ("2024-01-20T12:00:00", True, {"kind": "user"})
    assert W.temporal_controls({"as_of": 0, "include_superseded": "yes"})[:2] == ("1970-01-01T00:00:00+00:00", False)
    for at in ("soon", [1], float("nan")):
        with pytest.raises(ValueError):
            W.temporal_controls({"as_of": at})


def test_active_space():
    assert W.active_space("gemma") == ("gemma", 768) and W.active_space("disabled") is None and W.active_space(None) is None


def test_upsert_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "fact_id string, vector array<double>")
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    old, made = table([("a", [1.0, 2.0]), ("b", [3.0, 4.0])]), table([("a", [5.0, 6.0]), ("b", [1.0]), ("b", None), ("c", [7.0, 8.0]), ("x", [9.0, 9.0]), (None, [0.0, 0.0])])
    out = {r.fact_id: r.vector for r in W.upsert_vectors(old, made, facts, 2).collect()}
    assert out == {"a": [5.0, 6.0], "b": [3.0, 4.0], "c": [7.0, 8.0]}
    assert W.upsert_vectors(old, table([]), facts, 2).count() == 2 and W.upsert_vectors(table([]), made, facts, 2).count() == 2


def test_reembed_embeds_each_text_once(spark):
    facts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("d", None), ("e", "long"), ("f", "y")], "id string, data string")
    table = lambda ids: spark.createDataFrame([(i, [0.0]) for i in ids], "fact_id string, vector array<double>")
    out = W.reembed(facts, table("abcde"), table("a"), lambda t: F.when(F.length(t) < 3, F.array(F.length(t).cast("double"))), 1)
    assert sorted((r.fact_id, r.vector[0]) for r in out.collect()) == [("a", 0.0), ("b", 1.0)]


def test_forget_projections(spark):
    facts = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", None)], "id string, scope string")
    copies = W.project(facts.filter("id <> 'c'"), F.concat(F.lit("p_"), "id"))
    other = spark.createDataFrame([("q", "t", "a"), ("r", "s", None)], "id string, scope string, link_id string")
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    left = W.forget_projections(copies.unionByName(other), facts, gone("a", "a", "absent"))
    assert sorted(r.id for r in left.collect()) == ["p_b", "q", "r"]
    with pytest.raises(ValueError, match="no scope"):
        W.forget_projections(copies, facts, gone("c")).collect()


def test_seeding_again_gives_the_same_ids(spark):
    corpus = spark.createDataFrame([("k", "t", "user", "d"), ("k", "t", "user", "d"), ("k", "u", None, None), ("e", " ", "user", ""), ("n", None, None, None)], "key string, text string, kind string, description string")
    first, again = (W.seed(corpus, "bench").collect() for _ in range(2))
    assert sorted(first, key=str) == sorted(again, key=str)
    assert sorted((r.key, r.failed) for r in W.manifest(W.seed(corpus, "bench")).collect()) == [("e", True), ("k", False), ("k", False), ("k", False), ("n", True)]
    facts = W.seed(corpus, "bench").filter("id is not null")
    assert W.unseed(facts, W.manifest(W.seed(corpus, "bench"))).count() == 0 and W.unseed(facts, W.manifest(W.seed(corpus, "other"))).count() == 3


def test_payloads(spark):
    rows = [("a", "s", '{"data":"x","user_id":"s"}'), ("b", "s", '{"data":3,"kind":7,"m":{"k":[1]}}'), ("c", "s", "no json"), ("d", "s", None), ("e", "s", "[1]")]
    table = spark.createDataFrame(rows, "id string, scope string, payload string")
    out = {r.id: (r.text, r.kind, r.metadata) for r in W.entries(table).collect()}
    assert out == {"a": ("x", None, None), "b": ("3", None, '{"kind":7,"m":{"k":[1]}}'), "c": ("", None, None), "d": ("", None, None), "e": ("", None, None)}
    assert [r.id for r in W.having_payload(table, kind="7", data=3, more=None).collect()] == ["b"]
    times = [('{"updated_at":"x","updatedAt":"2024-01-02 00:00:00","created_at":0}', "2024-01-02 00:00:00"), ('{"created_at":1000}', "1970-01-01 00:00:01"), ("{}", None), ("[]", None), (None, None)]
    got = spark.createDataFrame(times, "payload string, want string").select(W.changed_at(F.col("payload")).cast("string").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_ranked_keys(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, None, 2, 0.8), (1, "a", 3, 0.7), (1, "b", 4, 0.6), (2, None, 1, 0.5)], "query_id int, key string, rank int, score double")
    assert sorted(tuple(r) for r in W.ranked_keys(hits).collect()) == [(1, "a", 1, 0.9), (1, "b", 2, 0.6)]


def test_prompts(spark):
    shown = spark.range(1).select(M.prompt("qwen3", "query", F.lit("t")), M.prompt("granite", "query", F.lit("t")), M.prompt("harrier", "document", F.lit("t")), M.prompt("gemma", "document", F.lit(None).cast("string"))).first()
    assert tuple(shown) == (f"Instruct: {M.TASK}\nQuery:t", "t", "t", None)
