"""Histories, forgetting, folders of topic files, entries, filters, round trips and measures: against SQL, and hand-made cases."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from factlake.functions import topics as P
from factlake.operators import evaluation as E
from factlake.operators import lifecycle as L
from factlake.operators import scorecard
from factlake.operators import writing as W
from factlake.operators.ranking import previous
from factlake.plans import upkeep
from factlake.sources import log as G
from factlake.sources import folders, topics

SF = "/root/testdata/sf0.01"
QUERIES, SQL = upkeep.queries(), upkeep.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = sorted(got.columns)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in order) for r in cur.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want and want


def test_values_before_rows_of_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 7919 % 4001).alias("o"), F.when(F.col("id") % 50 == 3, F.col("id")).alias("v")).repartition(5)
    want, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        want[r.g, r.o] = last.get(r.g)
        if r.v is not None:
            last[r.g] = r.v
    assert {(r.g, r.o): r.p for r in previous(rows, ["g"], "o", F.col("v"), "p").collect()} == want
    assert previous(rows.limit(0), ["g"], "o", F.col("v"), "p").count() == 0


def _log(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, op string, id string, payload string")
    return df.select("*", F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("by"))


def test_history_across_batches(spark, tmp_path):
    at = f"{tmp_path}/log"
    G.append(_log(spark, ("patch", "a", "{}"), ("upsert", "a", '{"n":1}'), ("upsert", "a", '{"n":2}'), ("upsert", "b", None)), at)
    G.append(_log(spark, ("patch", "a", '{"m":3}'), ("invalidate", "a", None), ("delete", "a", None), ("delete", "a", None), ("patch", "a", "{}"), ("upsert", "a", '{"n":4}'), ("delete", "b", None)), at)
    got = [(r.id, r.event, r.old, r.new) for r in G.history(spark, at).orderBy("id", "seq").collect()]
    one, two = '{"n":1}', '{"n":2}'
    assert got == [("a", "ADD", None, one), ("a", "UPDATE", one, two), ("a", "UPDATE", two, '{"m":3}'), ("a", "DELETE", two, None), ("a", "ADD", None, '{"n":4}'), ("b", "ADD", None, None), ("b", "DELETE", None, None)]


def test_forgetting_a_scope(spark, tmp_path):
    at, now = f"{tmp_path}/log", F.lit("2024-02-01").cast("timestamp")
    rows = _log(spark, ("upsert", "a", '{"user_id":"x"}'), ("upsert", "b", '{"user_id":"y"}'), ("upsert", "c", "{}"), ("upsert", "d", None))
    G.append(rows.withColumn("vector", F.array(F.lit(1.0))), at)
    for scope in (None, ""):
        with pytest.raises(ValueError, match="no scope"):
            G.forget_scope(spark, at, scope, now)
    G.forget_scope(spark, at, "x", now)
    G.forget_scope(spark, at, "nobody", now)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(G.state(spark, at)) == ids(G.vectors(spark, at)) == {"b", "c", "d"}
    assert L.forgotten_scope(spark.createDataFrame([], "id string, scope string"), "x", now).count() == 0


def test_archiving_many_files(spark, tmp_path):
    at = tmp_path / "topics"
    (at / "archive").mkdir(parents=True)
    for n in ("one", "two", "three"):
        (at / f"{n}.md").write_text(n)
    (at / "archive" / "one.md").write_text("older")
    (tmp_path / "out.md").write_text("outside")
    names = spark.createDataFrame([("one",), ("one",), ("two",), ("../out",), ("absent",), (None,), ("",)], "id string")
    for _ in range(2):  # a second pass finds nothing more to do
        topics.archive_all(names, at.as_uri())
        assert [p.name for p in at.glob("*.md")] == ["three.md"] and (tmp_path / "out.md").exists()
        assert sorted(p.read_text() for p in (at / "archive").glob("*.md")) == ["older", "one", "two"]


def test_folder_is_listed_and_read_in_the_tasks(spark, tmp_path):
    at = tmp_path / "some topics"
    (at / "archive").mkdir(parents=True)
    (at / "folder.md").mkdir()
    want = {"a b.md": "one", "é.md": "two", "empty.md": "", "long.md": "x" * (5 << 20)} | {f"n{i}.md": f"body {i}" for i in range(40)}
    for n, t in (want | {"MEMORY.md": "index", ".hidden.md": "h", "_hidden.md": "h", "other.txt": "o", "archive/old.md": "old"}).items():
        (at / n).write_text(t)
    os.utime(at / "empty.md", ns=(0, 1_700_000_000_123_456_789))
    for path in (str(at), f"file:{at}"):
        df = topics.read_folder(spark, path)
        assert [f for f in df.inputFiles() if f.endswith(".md")] == []  # no entry a file in the driver
        rows = df.selectExpr("file", "id", "cast(unix_millis(modified) as long) ms", "body").collect()
        assert len(rows) == len(want) and {r.file: r.body for r in rows} == want and all(r.id + ".md" == r.file for r in rows)
        assert [r.ms for r in rows if r.file == "empty.md"] == [1_700_000_000_123]
    (at / "later.md").write_text("not there at the call")
    assert df.count() == len(want) and topics.read_folder(spark, str(at)).count() == len(want) + 1
    assert topics.read_folder(spark, str(at / "archive")).select("body").first()[0] == "old" and topics.read_folder(spark, str(at / "folder.md")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        topics.read_folder(spark, str(at / "none"))


def test_contents_of_a_folder_are_not_broadcast(spark, tmp_path):
    (tmp_path / "a.md").write_text("a")
    patches = spark.range(100_000).selectExpr("cast(id as string) id", "'t' text", "'d' description", "'k' kind", "'s' scope", "cast(null as string) extra")
    plan = topics.changed(topics.read_folder(spark, str(tmp_path)), patches)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cleared_folders_leave_nothing(spark, tmp_path, monkeypatch):
    at = tmp_path / "made"
    (at / "sub" / "deep").mkdir(parents=True)
    for n in ("a", ".b", "sub/c", "sub/deep/d"):
        (at / n).write_text(n)
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "e").write_text("e")
    (at / "link").symlink_to(tmp_path / "kept")
    monkeypatch.setattr(folders, "_MADE", {f"file:{at}": spark, f"{tmp_path}/never-made": spark})
    folders._clear()
    assert not at.exists() and (tmp_path / "kept" / "e").exists() and not folders._MADE


def test_safe_names(spark):
    cases = {"a": True, "a.b-c_d": True, "a\n": False, "..": False, "a..b": False, ".a": False, "a/b": False, "": False, "é": False}
    rows = spark.createDataFrame(list(cases.items()), "n string, want boolean").select("n", "want", P.safe_id(F.col("n")).alias("got")).collect()
    assert [r.n for r in rows if r.got != r.want] == []


def test_file_entries(spark):
    schema = "file string, id string, modified timestamp, name string, description string, type string, scope string, kind string, extra string, body string"
    files = spark.createDataFrame([("a.md", "a", None, "a", "said", "user", None, None, '{"type":"mine","n":[1]}', " \n"), ("b.md", "b", None, "b", "said", "user", "s", "k", None, " text\n")], schema)
    read = lambda df: {r.id: (r.text, r.kind, r.scope, __import__("json").loads(r.metadata)) for r in df.collect()}
    one = {"type": "mine", "description": "said", "file": "a.md", "n": [1]}
    two = {"type": "user", "description": "said", "file": "b.md"}
    assert read(topics.entries(files, F.lit("q"))) == {"a": ("said", "user", "q", one), "b": ("text", "k", "s", two)}
    assert read(topics.entries(files, F.lit("q"), False))["a"][2] == "local"


def test_controls(spark):
    cases = [(None, (None, False, None, False)), ("[1]", (None, False, None, False)), ('{"as_of":"soon"}', (None, False, None, True)), ('{"as_of":{},"a":{"b":1}}', (None, False, '{"a":{"b":1}}', True)), ('{"as_of":null,"include_superseded":"TRUE"}', (None, False, None, False)), ('{"include_superseded":2}', (None, False, None, False))]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, f string").select("i", W.controls(F.col("f")).alias("c")).collect()
    assert {r.i: tuple(r.c) for r in rows} == {i: c[1] for i, c in enumerate(cases)}


def test_measures_in_the_scorecard(spark):
    calls = spark.createDataFrame([("s", "search", float(i), 0.001) for i in range(1, 101)] + [("s", "remember", None, None), ("t", "search", 7.0, 0.0)], "store string, call string, ms double, cost double")
    m = E.measures(calls)
    assert {(r.store, r.call): (r.n, r.p50, r.p95, r.cost_per_1k and round(r.cost_per_1k, 9)) for r in m.collect()} == {("s", "search"): (100, 50.0, 95.0, 1.0), ("s", "remember"): (1, None, None, None), ("t", "search"): (1, 7.0, 7.0, 0.0)}
    text = scorecard.scorecard(["s", "t"], [], [], m)
    assert "| search p95 | 95ms | 7ms |" in text and "| cost / 1k search calls | $1.00 | $0 |" in text and "| remember p50 | — | — |" in text


@pytest.mark.parametrize("seed", range(3))
def test_sizes_equal_a_search_each(spark, seed):
    """Ranks of every size are those of the hits that it has, whatever layer they come from."""
    rnd = random.Random(seed)
    rows = [(q, f"k{i:03}", rnd.randrange(5) / 4, rnd.choice([None, rnd.randrange(40)])) for q in range(4) for i in range(60)]
    hits = spark.createDataFrame(rows, "query_id int, key string, score double, place long")
    sizes = [30, 0, 10, 10]
    want = set()
    for q in range(4):
        for s in set(sizes):
            there = sorted((-score, key) for i, key, score, place in rows if i == q and (place is None or place < s))
            want |= {(q, s, key, n + 1) for n, (_, key) in enumerate(there[:7])}
    assert {(r.query_id, r["size"], r.key, r["rank"]) for r in E.at_sizes(hits, sizes, 7).collect()} == want


def test_scale_and_reach_in_the_scorecard(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none")], "query_id int, class string")
    expected = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, key string")
    hits = spark.createDataFrame([(1, "x", 0.5, None), (2, "y", 0.5, None), (2, "far", 0.9, 50), (3, "far", 0.2, 150)] + [(1, f"n{i}", 0.8, i) for i in range(5)], "query_id int, key string, score double, place long")
    times = spark.createDataFrame([(0, 3.0), (0, 4.0), (0, None), (100, 9.0)], "size long, ms double")
    curve = E.scale_curve(gold, expected, hits, [0, 100, 1000], times)
    got = {r["size"]: (r.n, round(r.p5, 3), round(r.r10, 3), round(r.mrr, 3), r.fp, r.p50) for r in curve.collect()}
    assert got == {0: (3, 0.2, 1.0, 1.0, 0.0, 3.0), 100: (3, 0.1, 1.0, round((1 / 6 + 1 / 2) / 2, 3), 0.0, 9.0), 1000: (3, 0.1, 1.0, round((1 / 6 + 1 / 2) / 2, 3), 1.0, None)}
    assert {r["size"]: r.p50 for r in E.scale_curve(gold, expected, hits.limit(0), [5]).collect()} == {5: None}
    seeds = spark.createDataFrame([("s", 10, 2), ("other", 1, 0)], "store string, n long, failed long")
    text = scorecard.scorecard(["s", "t"], [], [], scale=curve.withColumn("store", F.lit("s")), reach={"t": {"history": "yes"}, "s": {"spaces": "by mode", "history": "no"}, "other": {"x": "y"}}, seeded=seeds)
    assert text.splitlines()[2:] == ["| seeded (of corpus) | 8/10 | — |", "| P@5 / search p50 at 0 | 20% / 3ms | — |", "| P@5 / search p50 at 100 | 10% / 9ms | — |", "| P@5 / search p50 at 1000 | 10% / — | — |", "| reach: spaces | by mode | — |", "| reach: history | no | yes |"]


def test_distinctive_tokens(spark):
    cases = {None: "", "": "", "One two": "one two", "Relays relay-x a": "relay-x", "abcdef uvwxyz": "abcdef", "Short words only, no more": "short words ", "word " * 20000 + "singular": "singular"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", P.distinctive_token(F.col("t")).alias("got")).collect()
    assert [tuple(r) for r in rows if r.got != r.want] == []
