"""Vectors in the log and in spaces, extraction, planned requests, and what is read from payloads."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import extraction as X
from factlake.operators import lifecycle as L
from factlake.operators import planning as P
from factlake.operators import writing as W
from factlake.sources import log as G
from factlake.sources import spaces
from factlake.streaming import ingest

CHANGE = "n long, op string, id string, payload string, at timestamp, by string, vector array<double>"
AT = "2024-01-01 00:00:00"


def _changes(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, op string, id string, payload string, vector array<double>")
    return df.select("n", "op", "id", "payload", (F.lit(AT).cast("timestamp") + F.make_interval(hours=F.col("n"))).alias("at"), F.lit(None).cast("string").alias("by"), "vector")


def _vectors(spark, path):
    return {r.id: (r.vector, r.embedded_at.hour) for r in G.vectors(spark, path).collect()}


def test_log_keeps_facts_and_vectors_together(spark, tmp_path):
    at = f"{tmp_path}/log"
    G.append(_changes(spark, ("upsert", "a", '{"data":"x"}', [1.0, 2.0]), ("upsert", "b", '{"data":"y"}', [3.0, 4.0]), ("embed", "z", None, [9.0, 9.0]), ("upsert", "c", '{"data":"z"}', [5.0, 6.0])), at, 2)
    G.append(_changes(spark, ("embed", "a", None, [7.0, 8.0]), ("delete", "b", None, None), ("patch", "c", '{"kind":"k"}', None), ("delete", "c", None, None), ("upsert", "c", '{"data":"again"}', [0.0, 1.0]), ("invalidate", "a", None, None)), at, 2)
    want = {"a": ([7.0, 8.0], 0), "c": ([0.0, 1.0], 4)}
    assert _vectors(spark, at) == want
    assert {r.id for r in G.state(spark, at).collect()} == {"a", "c"}
    G.compact(spark, at, f"{tmp_path}/less")
    assert _vectors(spark, f"{tmp_path}/less") == want
    assert {(r.id, r.payload, r.invalid_at) for r in G.state(spark, f"{tmp_path}/less").collect()} == {(r.id, r.payload, r.invalid_at) for r in G.state(spark, at).collect()}


@pytest.mark.parametrize("bad", [("upsert", "x", "{}", [1.0]), ("upsert", "x", "{}", None), ("upsert", "x", None, [1.0, 2.0]), ("embed", "x", None, [1.0, 2.0, 3.0])])
def test_a_wrong_vector_refuses_the_whole_batch(spark, tmp_path, bad):
    at = f"{tmp_path}/log"
    G.append(_changes(spark, ("upsert", "a", "{}", [1.0, 2.0])), at, 2)
    with pytest.raises(ValueError, match="change of x"):
        G.append(_changes(spark, ("upsert", "b", "{}", [1.0, 2.0]), bad), at, 2)
    assert set(_vectors(spark, at)) == {"a"} and G.next_batch(spark, at) == 1


def test_junk_entities_are_not_written_whatever_their_vector(spark, tmp_path):
    at, entity = f"{tmp_path}/log", '{"entityType":"COMPOUND","data":"%s"}'
    G.append(_changes(spark, ("upsert", "junk", entity % "of the", [1.0]), ("upsert", "good", entity % "release gate", [1.0, 2.0]), ("upsert", "plain", '{"data":"of the"}', [1.0, 2.0])), at, 2)
    assert set(_vectors(spark, at)) == {"good", "plain"}


def test_stream_carries_vectors(spark, tmp_path):
    _changes(spark, ("upsert", "a", "{}", [1.0, 2.0]), ("embed", "a", None, [2.0, 3.0])).write.parquet(f"{tmp_path}/in")
    ingest.ingest(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/check", 2).awaitTermination()
    assert _vectors(spark, f"{tmp_path}/log") == {"a": ([2.0, 3.0], 1)}


def test_spaces_are_read_by_themselves(spark, tmp_path):
    at, widths = f"{tmp_path}/spaces", {"one": 2, "two": 3}
    df = lambda *rows: spark.createDataFrame(rows, "fact_id string, vector array<double>").withColumn("embedded_at", F.lit(AT).cast("timestamp"))
    assert spaces.write(df(("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)), at, "one", widths) == 0
    assert spaces.write(df(("a", [1.0, 2.0, 3.0]), ("d", [4.0, 5.0, 6.0])), at, "two", widths) == 0
    assert spaces.write(df(("a", [9.0, 9.0])), at, "one", widths) == 1
    read = lambda mode: {r.fact_id: r.vector for r in spaces.read(spark, at, mode, widths).collect()}
    assert read("one") == {"a": [9.0, 9.0]} and read("two") == {"a": [1.0, 2.0, 3.0], "d": [4.0, 5.0, 6.0]}
    assert read(None) == read("disabled") == {}
    facts = spark.createDataFrame([("a",), ("d",), ("e",)], "id string")
    missing = lambda mode: {r.id for r in spaces.missing(spark, at, mode, facts, widths).collect()}
    assert missing("one") == {"d", "e"} and missing("two") == {"e"} and missing(None) == set()
    plan = spaces.scan(spark, at, "one")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mode" in plan
    with pytest.raises(ValueError):
        spaces.write(df(), at, "three", widths)


def test_extraction_tells_failures_and_repeats_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "boom x"), (5, "c"), (6, " ")], "k long, text string").repartition(3)

    def by(text):
        for w in text.split():
            if w == "x":
                raise RuntimeError("no x")
            yield w

    out = X.extract(rows, by, ["k"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, "a", None), (1, 1, "b", None), (4, None, None, "RuntimeError: no x"), (5, 0, "c", None)], key=str)
    put = X.changes(out, ["k"], F.lit("me"), F.lit(AT).cast("timestamp"))
    at = f"{tmp_path}/log"
    G.write_batch(put, at, 0)
    once = G.state(spark, at).collect()
    G.write_batch(put, at, 0)  # a batch that runs again
    assert sorted(G.state(spark, at).collect()) == sorted(once) and len(once) == 3
    # Another extractor: what it makes no more goes, an origin that fails keeps what it has, and facts of other origins stay.
    facts = G.state(spark, at)
    other = lambda text: [w.upper() if w == "b" else w for w in text.split()] if text != "c" else 1 / 0
    affected = facts.filter(F.get_json_object("payload", "$.origin").isin("1", "5"))
    redo, failed = X.again(facts, affected, rows, other, ["k"], F.lit("me"), F.lit(AT).cast("timestamp"))
    G.append(redo, at)
    now = {F_: o for F_, o in G.state(spark, at).select(F.get_json_object("payload", "$.data"), F.get_json_object("payload", "$.origin")).collect()}
    assert now == {"a": "1", "B": "1", "c": "5"} and [(r.k, r.error[:17]) for r in failed.collect()] == [(5, "ZeroDivisionError")]


def test_planned_requests(spark):
    rows = [
        (1, "s", "one", "user", True, '{"kind":"old","x":{"y":1}}', True, None), (2, "s", "two", None, None, None, True, "other"), (3, "s", "bad", None, None, "[]", True, "other"), (4, "s", "ok", None, None, None, True, "bad"),
        (5, "s", " ", None, None, None, True, None), (6, "s", "split", "k", False, None, False, "other"), (7, "s", "nothing", None, None, None, None, None), (8, "s", "two", None, None, None, True, "two"),
    ]
    requests = spark.createDataFrame(rows, "request long, scope string, text string, kind string, shareable boolean, metadata string, verbatim boolean, embed_text string")
    uuid = "00000000-0000-0000-0000-00000000000"

    def extract(df):
        events = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(e).alias("event"), F.lit(i).alias("id"), F.lit(t).alias("text")) for n, e, i, t in [(0, "add", uuid + "1", "p"), (1, "ADD", "no uuid", "q"), (2, "update", uuid + "2", "r"), (3, "delete", uuid + "3", ""), (4, "none", None, "t"), (5, "ADD", uuid + "5", "bad")]])
        return df.filter("text = 'split'").select("request", F.inline(events))

    seen = {"one": [1.0, 0.0], "two": [2.0, 0.0], "other": [9.0, 9.0], "ok": [4.0, 0.0], "bad": [1.0], "p": [5.0, 0.0], "q": [6.0, 0.0], "r": [7.0, 0.0]}
    table = F.create_map(*[x for k, v in seen.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    changes, outcomes = P.plan(requests, extract, lambda t: table[t], 2, F.lit(AT).cast("timestamp"))
    got = {(r.op, r.data, tuple(r.vector or ())) for r in changes.withColumn("data", F.get_json_object("payload", "$.data")).collect()}
    assert got == {("upsert", "one", (1.0, 0.0)), ("upsert", "two", (9.0, 9.0)), ("upsert", "two", (2.0, 0.0)), ("upsert", "ok", (4.0, 0.0)), ("upsert", "p", (9.0, 9.0)), ("upsert", "q", (9.0, 9.0)), ("upsert", "r", (7.0, 0.0)), ("delete", None, ())}
    assert {r.request: (len(r.ids), r.stored, r.failed) for r in outcomes.collect()} == {1: (1, 1, 0), 2: (1, 1, 0), 3: (0, 0, 1), 4: (1, 1, 0), 5: (0, 0, 0), 6: (2, 3, 1), 7: (0, 0, 0), 8: (1, 1, 0)}
    first = changes.filter(F.get_json_object("payload", "$.data") == "one").select(*[F.get_json_object("payload", f"$.{k}") for k in ("kind", "shareable", "user_id", "x.y")]).first()
    assert tuple(first) == ("user", "true", "s", "1")


def test_payload_filters(spark):
    df = spark.createDataFrame([("a", '{"n":3}'), ("b", '{"n":3.5}'), ("c", '{"n":"3"}'), ("d", None)], "id string, payload string")
    ids = lambda **w: {r.id for r in W.having_payload(df, **w).collect()}
    assert ids(n=3.0) == ids(n=3) == ids(n="3") == {"a", "c"} and ids(n=3.5) == {"b"} and ids(**{"-": "x"}) == set() and ids(n=None) == {"a", "b", "c", "d"}


def test_two_vectors_for_one_fact(spark):
    df = lambda rows, more="": spark.createDataFrame(rows, f"fact_id string, vector array<double>{more}")
    facts, old = spark.createDataFrame([("a",), ("b",)], "id string"), df([("a", [0.0, 0.0])])
    got = lambda made: {(r.fact_id, *r.vector) for r in W.upsert_vectors(old, made, facts, 2).collect()}
    assert got(df([("a", [5.0, 1.0], 1), ("a", [4.0, 1.0], 2), ("b", [1.0], 3)], ", at int")) == {("a", 4.0, 1.0)}
    assert got(df([("a", [5.0, 1.0]), ("a", [4.0, 1.0])])) == {("a", 5.0, 1.0)}
    with pytest.raises(ValueError):
        W.reembed(facts, old, old, lambda t: t, 2)


def test_newest_rows_of_a_hot_scope(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("scope"), (F.col("id") % 500).alias("created_at"), F.lit("k").alias("kind"))
    got = [r.id for r in L.capped(rows, 1200).collect()]
    assert sorted(got) == sorted(r.id for r in rows.orderBy(F.desc("created_at"), "id").limit(1200).collect())
