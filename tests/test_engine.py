"""Topic files, the change log, streaming ingest, searches and round trips on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from factlake.functions import topics as P
from factlake.operators import engine as N
from factlake.operators import lifecycle as L
from factlake.operators import scorecard
from factlake.sources import log as G
from factlake.sources import synthetic, topics
from factlake.streaming import ingest

FACT = "ord long, text string, kind string, scope string, description string, extra string"


def test_parse_is_lenient(spark):
    cases = [
        ("---\nname: a\ntype: user\nmetadata:\n  type: project\n---\n\nbody\n", ("a", "", "user", None, None, None, "body")),
        ("---\r\nname: 'it''s'\r\ndescription: \"a \\\"b\\\"  c\"\r\nmetadata:\r\n  type: Feedback\r\n  scope: s\r\n  extra: [1]\r\n---\r\nx\r\n\r\n", ("it's", 'a "b" c', "feedback", "s", None, None, "x")),
        ("no head", ("", "", "project", None, None, None, "no head")),
        ('---\nmetadata:\n  type: odd\n  kind: k\n  extra: {"a":1}\n---', ("", "", "project", None, "k", '{"a":1}', "")),
        ("---\nname: x\n  extra: {bad\n---\nb", ("x", "", "project", None, None, None, "b")),
        ("", ("", "", "project", None, None, None, "")),
        (None, ("", "", "project", None, None, None, "")),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, c string").select("i", P.parse(F.col("c")).alias("t")).collect()
    assert {r.i: tuple(r.t) for r in rows} == {i: c[1] for i, c in enumerate(cases)}


def test_description_and_tokens(spark):
    cases = {"# h\n\nFirst sentence here. More": "First sentence here.", "---\nshort. x": "short. x", "a" * 200: "a" * 139 + "…", "": "", None: "", "two  spaces\tand tab": "two spaces and tab"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").select(P.describe(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    rows = spark.createDataFrame([("The zebra-quartz value", "zebra-quartz"), ("a b c", "a b c"), ("abcdef ghijkl", "abcdef")], "t string, want string").select(P.distinctive_token(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_folder_round_trip(spark, tmp_path):
    at = tmp_path / "topics"
    at.mkdir()
    (at / "MEMORY.md").write_text("index")
    (at / "archive").mkdir()
    (at / "archive" / "old.md").write_text("old")
    (at / "project_the_cache.md").write_text("---\nname: kept\n---\nkept cache\n")
    facts = [(1, "The cache", None, "a", None, None), (2, "The cache", None, "b", "", '{"z":1,"y":2}'), (3, "The cache 2", None, None, None, None), (4, "User likes tabs", "identity", "a", None, None), (5, "The cache", "odd", "a", None, None)]
    made = topics.new_topics(spark.createDataFrame(facts, FACT), topics.read_folder(spark, str(at)))
    assert topics.write_folder(made, at.as_uri()) == 5
    have = {r.id: r for r in topics.read_folder(spark, str(at)).collect()}
    assert set(have) == {"project_the_cache", "project_the_cache_2", "project_the_cache_3", "project_the_cache_4", "project_the_cache_5", "user_user_likes_tabs"}
    assert have["project_the_cache"].body == "kept cache" and have["project_the_cache_2"].scope is None and json.loads(have["project_the_cache_4"].extra) == {"z": 1, "y": 2}
    patch = spark.createDataFrame([("project_the_cache_4", "new body", None, None, None, '{"y":3}')], "id string, text string, description string, kind string, scope string, extra string")
    topics.write_folder(topics.changed(topics.read_folder(spark, str(at)), patch), at.as_uri())
    again = topics.read_folder(spark, str(at)).filter("id = 'project_the_cache_4'").first()
    assert again.body == "new body" and json.loads(again.extra) == {"z": 1, "y": 3} and again.description == "The cache"
    assert topics.archive(at.as_uri(), "user_user_likes_tabs") and not topics.archive(at.as_uri(), "user_user_likes_tabs") and not topics.archive(at.as_uri(), "../x")
    asked = spark.createDataFrame([(1, "cache", ["a", "b"]), (2, "??", ["a"]), (3, "tabs", ["a"])], "query_id int, query string, scopes array<string>")
    found = topics.search(topics.read_folder(spark, str(at)), asked)
    assert {(r.query_id, r.scope, r.id) for r in found.collect()} == {(1, "a", "project_the_cache"), (1, "a", "project_the_cache_2"), (1, "a", "project_the_cache_3"), (1, "a", "project_the_cache_5"), (1, "b", "project_the_cache_4")}
    only = topics.search(topics.read_folder(spark, str(at)), asked, unscoped_anywhere=False)
    assert "project_the_cache" not in {r.id for r in only.collect()}


CHANGE = "n long, op string, id string, payload string, at timestamp, by string"


def test_log_fold_patch_compact(spark, tmp_path):
    from datetime import datetime

    t = [datetime(2024, 1, d) for d in range(1, 9)]
    log = str(tmp_path / "log")
    put = lambda *rows: G.append(spark.createDataFrame(list(rows), CHANGE), log)
    put((0, "upsert", "a", '{"x":1,"o":{"p":1},"validity":3}', t[0], None), (1, "upsert", "b", "{}", t[0], None), (2, "upsert", "c", '{"k":1}', t[0], None), (3, "patch", "nobody", '{"k":1}', t[0], None))
    put((0, "patch", "a", '{"o":{"q":2},"n":null}', t[1], None), (1, "invalidate", "a", None, t[2], "b"), (2, "invalidate", "a", None, t[3], "z"), (3, "delete", "c", None, t[3], None))
    put((0, "upsert", "b", '{"new":true}', t[4], None))
    got = {r.id: r for r in G.state(spark, log).collect()}
    assert set(got) == {"a", "b"} and json.loads(got["a"].payload) == {"x": 1, "o": {"q": 2}, "n": None}
    assert (got["a"].invalid_at, got["a"].superseded_by, got["b"].payload, got["b"].created_at) == (t[2], "b", '{"new":true}', t[0])
    G.compact(spark, log, str(tmp_path / "small"))
    assert {tuple(r) for r in G.state(spark, str(tmp_path / "small")).collect()} == {tuple(r) for r in got.values()}


def test_stream_into_log(spark, tmp_path):
    rows = [(0, "upsert", "a", "{}", None, None), (1, "delete", "a", None, None, None), (2, "upsert", "b", '{"x":1}', None, None)]
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream(), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert [(r.id, r.payload) for r in G.state(spark, str(tmp_path / "log")).collect()] == [("b", '{"x":1}')] and G.read(spark, str(tmp_path / "log")).count() == 3


def test_events(spark):
    u = "0123ABCD-0000-1111-2222-0123456789ab"
    rows = [(1, u, "add", None), (1, "x", "ADD", None), (1, u, None, "update"), (1, u, "NONE", "ADD"), (2, None, None, None)]
    got = L.event_counts(spark.createDataFrame(rows, "request int, id string, event string, nested string")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 3), (2, 0, 0)}


def test_options():
    with pytest.raises(ValueError):
        N.SearchOptions(least_score=0.1)
    with pytest.raises(ValueError):
        N.SearchOptions(as_of="soon")
    assert N.SearchOptions(fusion_mode="cosine-gated").least_score is None


def test_synthetic_against_sequential(spark):
    def stream(seed):
        a = seed
        while True:
            a = (a + synthetic.STEP) & 0xFFFFFFFF
            t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
            t = ((t + (t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF) ^ t
            yield (t ^ t >> 14) / 2**32

    for seed in (1337, 0, 2**32 - 5):
        rng = stream(seed)
        want = [next(rng) for _ in range(500)]
        got = spark.range(1, 501).select("id", synthetic.draw(seed, F.col("id")).alias("u")).collect()
        assert [r.u for r in sorted(got)] == want


def test_round_trips(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    specs = [(1, "The zirconium relay drops packets", "which relay drops packets", "The palladium relay is fixed", "The zirconium relay is dropping packets", None), (2, "Nothing alike qwertyuiop", "other words", "Updated asdfghjkl", "Nothing alike", "qwertyuiop")]
    got = scorecard.round_trips(spark.createDataFrame(specs, "spec_id int, fact string, paraphrase string, updated string, near_dup string, marker string"), str(tmp_path / "log"))
    assert {tuple(r) for r in got.collect()} == {(1, True, 1, True, True, True, 1), (2, True, 0, False, True, True, 1)}
    metric = spark.createDataFrame([("overall", 2, 0.2, 1.0, 0.5, None)], "class string, n long, p5 double, r10 double, mrr double, fp double")
    text = scorecard.scorecard(["log"], [metric], [got])
    assert "| paraphrase recall (top 3) | 1/2 |" in text and "| P@5 overall | 20% |" in text
