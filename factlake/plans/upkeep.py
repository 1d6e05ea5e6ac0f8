"""Queries of what keeps a store in order: its history, forgetting, folders of topic files, entries, filters, round trips and measures; and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import topics as P
from factlake.operators import evaluation as E
from factlake.operators import lifecycle as L
from factlake.operators import retrieval as R
from factlake.operators import scorecard
from factlake.operators import writing as W
from factlake.plans import catalogue as C
from factlake.plans import engine as G
from factlake.plans import store
from factlake.sources import facts as S
from factlake.sources import folders, topics
from factlake.sources import log as log_


def change_history(spark, d):
    """What the events' changes did to their users' rows, errors being patches."""
    log = S.change_log(spark, d)
    out = L.history(log.withColumn("op", F.when(F.col("op") == "invalidate", "patch").otherwise(F.col("op"))))
    return out.select("id", "seq", "event", "old", "new", "at")


def _as_log(spark, d):
    """The facts as a log's upserts with their vectors (null where they have none)."""
    f = S.facts(spark, d).join(S.vectors(spark, d), F.col("id") == F.col("fact_id"), "left")
    payload = F.to_json(F.struct("data", F.col("scope").alias("user_id"), "kind", F.when(F.col("ord") % 3 == 0, F.struct(F.lit("current").alias("status"))).alias("validity")))
    return f.select(F.col("ord").alias("n"), F.lit("upsert").alias("op"), "id", payload.alias("payload"), F.col("created_at").alias("at"), F.lit(None).cast("string").alias("by"), "vector")


def scope_forgotten(spark, d):
    """The facts that are left once a scope was forgotten, and whether they have vectors."""
    at = folders.scratch(spark, "forgotten")
    log_.append(_as_log(spark, d), at)
    log_.forget_scope(spark, at, "de", F.lit(S.NOW).cast("timestamp"))
    made = log_.vectors(spark, at).select("id", F.lit(True).alias("made"))
    return log_.state(spark, at).join(made, "id", "left").select("id", F.get_json_object("payload", "$.user_id").alias("scope"), F.coalesce("made", F.lit(False)).alias("has_vector"))


def validity_not_stored(spark, d):
    """Payloads as a log keeps them: a validity that a caller sends back is computed on reading, and so isn't stored."""
    at = folders.scratch(spark, "echo")
    log_.append(_as_log(spark, d), at)
    value = lambda k: F.get_json_object("payload", f"$.{k}")
    return log_.state(spark, at).select("id", value("validity").alias("validity"), value("kind").alias("kind"), F.sha2(value("data"), 256).alias("text_key"))


def topic_folder(spark, d):
    """A folder of the facts as topic files, after every third was changed and every fifth archived."""
    at = folders.scratch(spark, "topics")
    name = F.concat(F.lit("f_"), F.col("id"))
    files = G._topics(spark, d)
    topics.write_folder(files.select(name.alias("id"), "content"), at)
    some, none = S.facts(spark, d).filter("ord % 3 = 0").withColumn("id", name), F.lit(None).cast("string")
    patches = some.select("id", none.alias("text"), F.col("name").alias("description"), F.lit("changed").alias("kind"), none.alias("scope"), F.concat(F.lit('{"by":"'), "id", F.lit('"}')).alias("extra"))
    topics.write_folder(topics.changed(topics.read_folder(spark, at), patches), at)
    topics.archive_all(S.facts(spark, d).filter("ord % 5 = 0").select(name.alias("id")), at)
    extra = lambda k: F.get_json_object("extra", f"$.{k}").alias(k)
    return topics.read_folder(spark, at).select("id", "file", "description", "type", "scope", "kind", extra("ord"), extra("by"), F.sha2("body", 256).alias("body_key"))


def file_entries(spark, d):
    """The facts' topic files as entries of the scope `fr`; files without a text have their description."""
    blank = F.when(F.col("id").cast("long") % 4 == 0, F.lit(" ")).otherwise(F.col("body"))
    out = topics.entries(G._parsed(spark, d).withColumn("body", blank).withColumn("kind", F.when(F.col("id").cast("long") % 6 != 0, F.col("kind"))), F.lit("fr"))
    value = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.select("id", F.sha2("text", 256).alias("text_key"), "kind", "scope", value("file").alias("file"), value("type").alias("type"), value("modified_ms").cast("long").alias("modified_ms"), value("ord").alias("ord"))


def client_entries(spark, d):
    """A client's own rows as entries: kinds that are no strings don't count, and neither do metadata that are null or broken."""
    k = F.col("ord") % 6
    about = F.when(k == 0, "null").when(k == 1, "{oops").when(k == 2, F.concat(F.lit('{"kind":'), "id", F.lit("}"))).when(k == 3, F.concat(F.lit('{"kind":"'), "kind", F.lit('"}'))).when(k == 4, '{"n":1}')
    rows = S.facts(spark, d).select("id", F.when(F.col("ord") % 9 > 0, F.col("data")).alias("text"), "scope", F.when(F.col("ord") % 2 == 0, F.col("ord") / 8).alias("score"), about.alias("metadata"))
    return W.client_entries(rows).withColumn("text", F.sha2("text", 256))


def _filters():
    """Filters of benchmark items, by number: times as text and as milliseconds, no time, other filters, nothing."""
    i = F.col("item_id").cast("string")
    hours = F.concat(F.lit("2024-01-01T"), F.lpad((F.col("item_id") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    forms = [
        F.concat(F.lit('{"as_of":"'), hours, F.lit('","kind":"user"}')), F.concat(F.lit('{"as_of":'), (F.col("item_id") * 1000).cast("string"), F.lit(',"include_superseded":"1"}')),
        F.concat(F.lit('{"as_of":"day '), i, F.lit('","include_superseded":true}')), F.concat(F.lit('{"kind":"k'), i, F.lit('","as_of":null,"include_superseded":"yes"}')), F.lit("{}"), F.lit(None).cast("string"), F.lit('{"as_of":true,"include_superseded":1}'),
    ]
    return F.get(F.array(*forms), (F.col("item_id") % 7).cast("int"))


def filter_controls(spark, d):
    """What the filters of requests ask for besides equality, and which requests fail, as their time is none."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", W.controls(_filters()).alias("c")).select("item_id", "c.as_of", "c.include_superseded", F.get_json_object("c.rest", "$.kind").alias("kind"), "c.failed")


def distinctive_tokens(spark, d):
    return S.facts(spark, d).select("id", P.distinctive_token(F.col("data")).alias("token"))


def safe_ids(spark, d):
    """Which pages' urls would be safe as names of files, and which of their last parts."""
    last = F.regexp_extract("url", "([^/]*)$", 1)
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", P.safe_id(F.col("url")).alias("whole"), P.safe_id(last).alias("last"), P.safe_id(F.concat(last, F.lit("\n"))).alias("with_line_feed"))


def _trips(spark, d):
    text = F.col("text")
    b = spark.read.parquet(f"{d}/benchmark.parquet").filter("text is not null")
    specs = b.select(
        F.col("item_id").alias("spec_id"), text.alias("fact"), F.when(F.col("item_id") % 5 == 0, "zqxjkvbw").otherwise(P.distinctive_token(text)).alias("paraphrase"), F.concat(F.lit("exchanged "), F.reverse(text)).alias("updated"),
        F.concat(text, F.lit(" again")).alias("near_dup"), F.when(F.col("item_id") % 7 == 0, "never there").alias("marker"),
    )
    return scorecard.round_trips(specs, folders.scratch(spark, "round-trips"))


def write_round_trips(spark, d):
    """Each benchmark text written, searched, changed, written again nearly the same and forgotten."""
    return _trips(spark, d)


def round_trip_counts(spark, d):
    return scorecard.fractions(_trips(spark, d))


def call_measures(spark, d):
    """Latencies and costs of calls: the events, by user and type, their values being milliseconds; every third costs nothing that is known."""
    e = spark.read.parquet(f"{d}/events.parquet")
    calls = e.select((F.col("user_id") % 3).cast("string").alias("store"), F.col("event_type").alias("call"), F.col("value").alias("ms"), F.when((F.col("event_id") % 3 > 0) & (F.col("event_type") != "view"), (F.col("event_id") % 8) / 8).alias("cost"))
    return E.measures(calls)


def best_floor(spark, d):
    """The floor of the best F1 over the lexical leg's ranking."""
    return E.best_floor(E.sweep(*store._judged(spark, d), store.FLOORS)).select("floor", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _crowd(spark, d):
    """The live facts, and turns of conversations layered around them; sizes are a tenth of the conversations and all of them."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    many = (turns.agg(F.max("conv_id")).first()[0] or 0) + 1
    sizes = [0, many // 10, many]
    step = F.when(F.col("conv_id") < sizes[1], "tenth").otherwise("rest")
    others = turns.select(step.alias("scope"), F.concat(F.lit("turn-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.col("conv_id").alias("ord"), F.lit(S.NOW).cast("timestamp").alias("created_at"), F.col("role").alias("name"), F.col("text").alias("data"), F.col("conv_id").alias("place"))
    own = C._live(spark, d).select("scope", "id", "ord", "created_at", "name", "data", F.lit(None).cast("long").alias("place"))
    return own.unionByName(others), sizes


def scale_curve(spark, d):
    """How the lexical leg's quality holds as conversations crowd the store: one search asks all layers, and the sizes come from its hits."""
    rows, sizes = _crowd(spark, d)
    gold, expected = store._gold(spark, d)
    asked = S.text_queries(spark, d).withColumn("scopes", F.array(*map(F.lit, [*S.SCOPES, "tenth", "rest"])))
    hits = R.lexical_leg(asked, rows, 18)
    place = F.when(F.col("scope").isin("tenth", "rest"), F.col("ord"))
    out = E.scale_curve(gold, expected, hits.select("query_id", F.col("id").alias("key"), "score", place.alias("place")), sizes)
    return out.select("size", "n", *[F.round(c, 6).alias(c) for c in ("p5", "r10", "mrr", "fp", "median_top_score")])


_ALL = (scale_curve, change_history, scope_forgotten, validity_not_stored, topic_folder, file_entries, client_entries, filter_controls, distinctive_tokens, safe_ids, write_round_trips, round_trip_counts, call_measures, best_floor)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    topic, _ = G.topic_sql()
    words = lambda t: f"list_filter(string_split_regex(lower({t}), '[^a-z0-9-]+'), lambda x: length(x) >= 6)"
    token = lambda t: f"coalesce(nullif(list_reduce(list_concat([''], {words(t)}), lambda best, x: CASE WHEN length(x) > length(best) THEN x ELSE best END), ''), left(lower({t}), 12))"
    safe = lambda t: f"regexp_matches({t}, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains({t}, '..')"
    layers = """, crowd AS (SELECT scope, id, created_at, name, data FROM live UNION ALL SELECT CASE WHEN conv_id < (SELECT (max(conv_id) + 1) // 10 FROM conversations) THEN 'tenth' ELSE 'rest' END, 'turn-' || conv_id || '-' || turn, TIMESTAMP '2024-03-01', role, text FROM conversations)"""
    crowd = layers + C.lexical_sql()[2].replace("live f", "crowd f").replace("'es')", "'es','tenth','rest')")
    trips = f"""t AS (SELECT item_id, lower(text) AS low, {token("text")} AS own, {token("'exchanged ' || reverse(text)")} AS changed, 'exchanged ' || reverse(lower(text)) AS later FROM benchmark WHERE text IS NOT NULL),
      trips AS (SELECT item_id AS spec_id, true AS stored, CAST(CASE WHEN item_id % 5 = 0 OR item_id % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS paraphrase_rank, item_id % 5 > 0 AND item_id % 7 > 0 AS paraphrase_found,
        contains(later, changed) AS update_honored, true AS forget_honored, CAST(1 AS BIGINT) AS near_dup_new FROM t)"""
    return {
        "change_history": """WITH log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, props AS payload, ts AS moment, CASE event_type WHEN 'error' THEN 'patch' WHEN 'purchase' THEN 'delete' ELSE 'upsert' END AS op FROM events),
          seen AS (SELECT *, last_value(CASE WHEN op <> 'patch' THEN struct_pack(op := op, payload := payload) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
          told AS (SELECT *, coalesce(before.op = 'upsert', false) AS there FROM seen)
          SELECT id, seq, CASE WHEN NOT there THEN 'ADD' WHEN op = 'delete' THEN 'DELETE' ELSE 'UPDATE' END AS event, CASE WHEN there THEN before.payload END AS old, CASE WHEN op <> 'delete' THEN payload END AS new, moment AS at FROM told WHERE there OR op = 'upsert'""",
        "scope_forgotten": f"WITH {C.FACTS} SELECT id, scope, vec_id IS NOT NULL AS has_vector FROM facts LEFT JOIN embeddings ON vec_id = ord WHERE scope IS DISTINCT FROM 'de'",
        "validity_not_stored": f"WITH {C.FACTS} SELECT id, CAST(NULL AS VARCHAR) AS validity, kind, sha256(data) AS text_key FROM facts",
        "topic_folder": f"""{topic} SELECT name AS id, name || '.md' AS file, CASE WHEN ord % 3 = 0 THEN (SELECT source FROM documents WHERE doc_id = ord) ELSE description END AS description, kind AS type, scope, CASE WHEN ord % 3 = 0 THEN 'changed' ELSE kind END AS kind,
          CAST(ord AS VARCHAR) AS ord, CASE WHEN ord % 3 = 0 THEN name END AS "by", sha256(body) AS body_key FROM topics WHERE ord % 5 <> 0""",
        "file_entries": f"""{topic} SELECT id, sha256(CASE WHEN ord % 4 = 0 OR body = '' THEN description ELSE body END) AS text_key, kind, coalesce(scope, 'fr') AS scope, id || '.md' AS file, kind AS type, epoch_ms(created_at) AS modified_ms, CAST(ord AS VARCHAR) AS ord FROM topics""",
        "client_entries": f"""WITH {C.FACTS} SELECT id, sha256(CASE WHEN ord % 9 > 0 THEN coalesce(data, '') ELSE '' END) AS text, CASE WHEN ord % 6 = 3 THEN kind END AS kind, scope, CASE WHEN ord % 2 = 0 THEN ord / 8.0::DOUBLE END AS score,
          CASE ord % 6 WHEN 2 THEN '{{"kind":' || id || '}}' WHEN 3 THEN '{{"kind":"' || kind || '"}}' WHEN 4 THEN '{{"n":1}}' END AS metadata FROM facts""",
        "filter_controls": """SELECT item_id, CASE item_id % 7 WHEN 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(item_id % 24 AS INT)) WHEN 1 THEN make_timestamp(item_id * 1000000) END AS as_of,
          item_id % 7 IN (1, 2, 6) AS include_superseded, CASE item_id % 7 WHEN 0 THEN 'user' WHEN 3 THEN 'k' || item_id END AS kind, item_id % 7 IN (2, 6) AS failed FROM benchmark""",
        "distinctive_tokens": f"WITH {C.FACTS} SELECT id, {token('data')} AS token FROM facts",
        "safe_ids": f"WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS l FROM pages) SELECT page_id, {safe('url')} AS whole, {safe('l')} AS \"last\", CASE WHEN url IS NOT NULL THEN false END AS with_line_feed FROM p",
        "write_round_trips": f"WITH {trips} SELECT * FROM trips",
        "round_trip_counts": f"WITH {trips} SELECT count(*) AS n, count(*) FILTER (stored) AS stored, count(*) FILTER (paraphrase_found) AS paraphrase_found, count(*) FILTER (update_honored) AS update_honored, count(*) FILTER (forget_honored) AS forget_honored, count(*) FILTER (stored AND near_dup_new = 0) AS merged FROM trips",
        "call_measures": """WITH calls AS (SELECT CAST(user_id % 3 AS VARCHAR) AS store, event_type AS call, value AS ms, CASE WHEN event_id % 3 > 0 AND event_type <> 'view' THEN (event_id % 8) / 8.0::DOUBLE END AS cost FROM events)
          SELECT store, call, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, sum(cost) * 1000 / count(*) AS cost_per_1k FROM calls GROUP BY store, call""",
        "scale_curve": f"""WITH {C.FACTS}{crowd}, n AS (SELECT max(conv_id) + 1 AS many FROM conversations), sizes AS (SELECT unnest([0, many // 10, many]) AS size FROM n),
          gold AS (SELECT item_id AS query_id, text FROM benchmark), expected AS (SELECT query_id, id AS key FROM gold JOIN live ON scope IN ('en','fr','de','es') AND contains(data, text)),
          placed AS (SELECT query_id, id AS key, CAST(score AS DOUBLE) AS score, CASE WHEN scope IN ('tenth', 'rest') THEN CAST(split_part(id, '-', 2) AS BIGINT) END AS place FROM lexleg),
          hits AS (SELECT query_id, size, key, score, row_number() OVER (PARTITION BY query_id, size ORDER BY round(score, 9) DESC, key) AS rank FROM placed JOIN sizes ON place IS NULL OR place < size QUALIFY rank <= 10),
          found AS (SELECT query_id, size, count(*) FILTER (rank <= 5) AS near, count(*) AS far, min(rank) AS first FROM hits SEMI JOIN expected USING (query_id, key) GROUP BY ALL),
          tops AS (SELECT query_id, size, max(score) AS top_score FROM hits GROUP BY ALL), wanted AS (SELECT query_id, count(*) AS n_expected FROM expected GROUP BY ALL),
          outs AS (SELECT size, coalesce(n_expected, 0) AS n_expected, coalesce(near, 0) AS near, coalesce(far, 0) AS far, coalesce(1 / first::DOUBLE, 0) AS rr, top_score FROM gold CROSS JOIN sizes LEFT JOIN wanted USING (query_id) LEFT JOIN found USING (query_id, size) LEFT JOIN tops USING (query_id, size))
          SELECT size, count(*) AS n, round(coalesce(avg(near / 5.0::DOUBLE) FILTER (n_expected > 0), 0), 6) AS p5, round(coalesce(avg(far / n_expected::DOUBLE) FILTER (n_expected > 0), 0), 6) AS r10, round(coalesce(avg(rr) FILTER (n_expected > 0), 0), 6) AS mrr,
            round(avg((top_score IS NOT NULL)::INT::DOUBLE) FILTER (n_expected = 0), 6) AS fp, round(-quantile_disc(-top_score, 0.5), 6) AS median_top_score FROM outs GROUP BY size""",
        "best_floor": f"SELECT * FROM ({store.oracle_sql()['floor_sweep']}) ORDER BY f1 DESC, floor LIMIT 1",
    }
