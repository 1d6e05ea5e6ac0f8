"""Queries of whole searches, topic files, the write path and what goes with them, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import topics as P
from factlake.operators import embedding as M
from factlake.operators import engine as N
from factlake.operators import lifecycle as L
from factlake.operators import retrieval as R
from factlake.plans import catalogue as C
from factlake.sources import facts as S
from factlake.sources import synthetic, topics

BARS = [0.1, 0.3, 0.5]


def _query_table(spark, d):
    """The text queries with the vector of the same number, and no lexical query of their own."""
    v = S.vectors(spark, d).select(F.col("fact_id").cast("long").alias("query_id"), "vector")
    return S.text_queries(spark, d).join(v, "query_id", "left").withColumn("lexical_query", F.lit("  "))


def hybrid_search(spark, d):
    out = N.hybrid(_query_table(spark, d), S.facts(spark, d), S.vectors(spark, d), S.NOW, N.SearchOptions(limit=8, depth=18, fusion_mode="floored-union", least_score=0.1))
    return out.select("query_id", "key", "cosine_rank", "lexical_rank", F.round("score", 9).alias("score"), "rank")


def hybrid_leg_stats(spark, d):
    return N.leg_stats(_query_table(spark, d), S.facts(spark, d), S.vectors(spark, d), S.NOW, N.SearchOptions(limit=8, depth=18, fusion_mode="floored-union", least_score=0.1))


def fuse_provenance(spark, d):
    out = C._fuse(C._legs(spark, d))
    return out.select("query_id", "key", "cosine_rank", "lexical_rank", F.round("cosine_score", 6).alias("cosine_score"), F.round("lexical_score", 6).alias("lexical_score"))


def fuse_min_lex_sweep(spark, d):
    cos, lex, _ = C._legs(spark, d)
    return _union(R.fuse_names(cos, lex, least_lexical=bar).groupBy().agg(F.count(F.lit(1)).alias("n"), F.count("lexical_rank").alias("with_lexical")).select(F.lit(bar).alias("bar"), "n", "with_lexical") for bar in BARS)


def _union(tables):
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def _topics(spark, d):
    """The facts as topic files: scopes are their languages, none for every fifth."""
    f = S.facts(spark, d)
    said, scope = P.describe(F.col("data")), F.when(F.col("ord") % 5 != 0, F.col("scope"))
    extra = F.concat(F.lit('{"ord":'), F.col("ord").cast("string"), F.lit("}"))
    return f.select("id", "created_at", P.serialize(F.concat(F.lit("f_"), F.col("id")), said, F.col("kind"), scope, F.col("kind"), extra, F.col("data")).alias("content"))


def _parsed(spark, d):
    return _topics(spark, d).select("id", F.concat("id", F.lit(".md")).alias("file"), F.col("created_at").alias("modified"), P.parse(F.col("content")).alias("t")).select("id", "file", "modified", "t.*")


def topic_parse(spark, d):
    return _parsed(spark, d).select("id", "name", "description", "type", "scope", "kind", "extra", F.sha2("body", 256).alias("body_key"))


def lex_score_file(spark, d):
    return topics.search(_parsed(spark, d), S.text_queries(spark, d)).select("query_id", "scope", "id", F.round("score", 6).alias("score"))


def topic_new_ids(spark, d):
    """Ids of every fact as a new topic file, described by its source so that many names clash."""
    f = S.facts(spark, d).select("ord", F.col("data").alias("text"), "kind", "scope", F.col("name").alias("description"), F.lit(None).cast("string").alias("extra"))
    taken = spark.createDataFrame([("user_src0",), ("user_src0_3",), ("user_src1_2",)], "id string")
    return topics.new_topics(f, taken).select("id")


def synthetic_corpus(spark, d):
    """As many made facts as there are documents."""
    return synthetic.corpus(spark, spark.read.parquet(f"{d}/documents.parquet").count()).select("ord", "key", F.sha2("text", 256).alias("text_key"), "description")


def payload_merge(spark, d):
    """The events' properties written over each other, by user: views and clicks write whole payloads, all others change keys."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type").isin("view", "click"), "upsert").otherwise("patch")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("third"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("even")))
    out = L.merged(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), payload.alias("payload")))
    return out.select("id", *[F.get_json_object("payload", f"$.{k}").alias(k) for k in ("k", "third", "even")])


def event_counts(spark, d):
    """By user as a request: ids added and rows stored, from events named at the top or below it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "UPDATE").otherwise("none")
    rows = e.select(F.col("user_id").alias("request"), F.when(F.col("event_id") % 4 > 0, F.md5(F.col("event_id").cast("string"))).alias("m"), F.when(F.col("event_id") % 2 == 0, name).alias("event"), name.alias("nested"))
    uuid = F.regexp_replace("m", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return L.event_counts(rows.withColumn("id", uuid))


def embedder_widths(spark, d):
    """What is wrong with declarations of widths, one for each vector, made of its width and number."""
    n, width = F.col("vec_id"), F.size("embedding")
    specs = spark.read.parquet(f"{d}/embeddings.parquet").select(
        n.alias("mode"), F.when(n % 11 == 0, 0).otherwise(width).alias("native"), F.get(F.array(*map(F.lit, ["none", "discrete", "continuous"])), (n % 3).cast("int")).alias("mrl"),
        F.when(n % 2 == 0, F.array(width, F.lit(32))).otherwise(F.array(width)).alias("trained"), (n % 6 * 16).cast("int").alias("target"),
        F.when(n % 5 == 0, F.when(n % 4 == 0, " ").otherwise("kept columns")).alias("reason"), F.when(n % 7 == 0, F.when(n % 4 == 1, "").otherwise("issue 1")).alias("tracked_by"),
    )
    return specs.select("mode", F.concat_ws("; ", M.width_problems()).alias("problems"))


def embed_known(spark, d):
    """Texts by whether they have a vector, when half of the distinct ones are known already."""
    texts = S.facts(spark, d).select("id", F.col("data").alias("text"))
    known = texts.filter("text <> ''").select(F.sha2(F.left("text", F.lit(M.MOST_CHARS)), 256).alias("key")).dropDuplicates(["key"]).filter("key < '8'").withColumn("vector", F.expr("cast(array(1, 0) as array<double>)"))
    made = M.embed(texts, lambda t: M.hashed(t, 2), known)
    return made.select("id", F.size("vector").alias("width"), (F.col("vector") == F.expr("cast(array(1, 0) as array<double>)")).alias("was_known"))


_ALL = (hybrid_search, hybrid_leg_stats, fuse_provenance, fuse_min_lex_sweep, topic_parse, lex_score_file, topic_new_ids, synthetic_corpus, payload_merge, event_counts, embedder_widths, embed_known)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def hybrid_sql(least: str = "score >= 0.1") -> str:
    """Common table expressions of a whole search of the text queries: both legs over all scopes, the cosine leg's floor, recency, and fusion (out)."""
    legs = _legs_sql()
    best = "SELECT query_id, id, arg_max(data, score) AS data, max(score) AS score, any_value(created_at) AS created_at FROM {} GROUP BY query_id, id"
    decay = "round(score * (0.9 + 0.1 * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(created_at)) / 86400000000.0) / 30.0)), 12)"
    whole = legs.replace("list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS score FROM live", "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS score, coalesce(updated_at, created_at) AS created_at FROM live")
    whole = whole.replace("SELECT query_id, scope, id, data, raw / (3.0 * n) AS score FROM pairs", "SELECT query_id, scope, id, data, created_at, raw / (3.0 * n) AS score FROM pairs")
    whole = whole.replace("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM cosleg", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {decay} DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM ({best.format('cosleg')}) WHERE {least}")
    whole = whole.replace("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM lexleg WHERE score >= 0.3", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM ({best.format('lexleg')}) WHERE score >= 0.3")
    return whole


def _legs_sql() -> str:
    legs = C.fused_sql()
    return legs[: legs.rindex("SELECT * FROM out")]


def topic_sql() -> tuple[str, str]:
    """Common table expressions of the facts as topic files, and of their scores for the text queries."""
    lines = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \\t\\r\\n\\f\\v')), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))"
    topic = f"""WITH {C.FACTS}, firsts AS (SELECT ord, id, data AS text, kind, name, scope, created_at, coalesce(({lines.replace('text', 'data')})[1], '') AS line FROM facts),
    flat AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(line || ' ', '^.{{10,}}?[.!?]\\s') THEN regexp_extract(line || ' ', '^(.{{10,}}?[.!?])\\s', 1) ELSE line END, '\\s+', ' ', 'g')) AS s FROM firsts),
    topics AS (SELECT ord, id, 'f_' || id AS name, CASE WHEN length(s) <= 140 THEN s ELSE rtrim(s[1:139]) || '…' END AS description, kind, CASE WHEN ord % 5 <> 0 THEN scope END AS scope, trim(text, E' \\t\\r\\n\\f\\v') AS body, created_at FROM flat)"""
    pairs = """, asked AS (SELECT item_id AS query_id, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: length(x) >= 2) AS tokens, unnest(['en', 'fr', 'de', 'es']) AS scope, unnest([0, 1, 2, 3]) AS place FROM benchmark),
    scored AS (SELECT query_id, a.scope, place, id, created_at, list_sum(list_transform(tokens, lambda x: CASE WHEN contains(id || '.md ' || name, x) THEN 3 WHEN contains(lower(description), x) THEN 2 WHEN contains(lower(body), x) THEN 1 ELSE 0 END)) / (3.0 * len(tokens)) AS score
      FROM topics t JOIN asked a ON (t.scope = a.scope OR t.scope IS NULL) WHERE len(tokens) > 0),
    top AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, created_at DESC, id) <= 10)"""
    return topic, pairs


def oracle_sql() -> dict[str, str]:
    whole, legs = hybrid_sql(), _legs_sql()
    topic, pairs = topic_sql()
    m, w = "CAST({} AS HUGEINT)", "4294967295"
    low = lambda x: f"(({x}) & {m.format(w)})"
    words = lambda ws: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ws) + "]"
    pick = lambda j, ws: f"({words(ws)})[CAST(floor(u[{j + 1}] * {len(ws)}) AS INT) + 1]"
    draws = f"""WITH i AS (SELECT range AS ord, unnest(range(1, 8)) AS j FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS range)), a AS (SELECT ord, j, {low(f"1337 + CAST(ord * 7 + j AS HUGEINT) * {synthetic.STEP}")} AS a FROM i),
    t AS (SELECT ord, j, {low("xor(a, a >> 15) * (a | CAST(1 AS HUGEINT))")} AS t FROM a), v AS (SELECT ord, j, xor({low("t + xor(t, t >> 7) * (t | CAST(61 AS HUGEINT))")}, t) AS v FROM t), v2 AS (SELECT ord, j, {low("v")} AS v FROM v),
    u AS (SELECT ord, list(CAST(xor(v, v >> 14) AS DOUBLE) / 4294967296.0::DOUBLE ORDER BY j) AS u FROM v2 GROUP BY ord)"""
    return {
        "hybrid_search": f"{whole} SELECT query_id, key, cosine_rank, lexical_rank, score, rank FROM out WHERE rank <= 8",
        "hybrid_leg_stats": f"{whole}, ids AS (SELECT item_id AS query_id FROM benchmark) SELECT query_id, (SELECT count(*) FROM c WHERE c.query_id = ids.query_id) AS cosine, (SELECT count(DISTINCT id) FROM lexleg x WHERE x.query_id = ids.query_id) AS lexical, (SELECT count(*) FROM l WHERE l.query_id = ids.query_id) AS qualifying, (SELECT count(*) FROM out WHERE out.query_id = ids.query_id) AS fused FROM ids",
        "fuse_provenance": f"{legs}, ls AS (SELECT l.query_id, coalesce(target, l.nt) AS key, arg_min(score, o) AS s FROM l LEFT JOIN alias a ON a.query_id = l.query_id AND a.nt = l.nt GROUP BY ALL) SELECT out.query_id, out.key, cosine_rank, lexical_rank, round(c.score, 6) AS cosine_score, round(CAST(ls.s AS DOUBLE), 6) AS lexical_score FROM out LEFT JOIN c ON c.query_id = out.query_id AND c.id = out.key AND cosine_rank IS NOT NULL LEFT JOIN ls ON ls.query_id = out.query_id AND ls.key = out.key AND lexical_rank IS NOT NULL",
        "fuse_min_lex_sweep": " UNION ALL ".join(f"SELECT * FROM ({C.fused_sql(bar).replace('SELECT * FROM out', f'SELECT CAST({bar} AS DOUBLE) AS bar, count(*) AS n, count(lexical_rank) AS with_lexical FROM out')})" for bar in BARS),
        "topic_parse": f"""{topic} SELECT id, name, description, kind AS type, scope, kind, '{{"ord":' || ord || '}}' AS extra, sha256(body) AS body_key FROM topics""",
        "lex_score_file": f"{topic}{pairs} SELECT query_id, scope, id, round(CAST(score AS DOUBLE), 6) AS score FROM top QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY place) = 1",
        "topic_new_ids": f"""WITH {C.FACTS}, taken AS (SELECT unnest(['user_src0', 'user_src0_3', 'user_src1_2']) AS id), f AS (SELECT ord, kind || '_' || name AS base, row_number() OVER (PARTITION BY kind || '_' || name ORDER BY ord) AS n FROM facts),
          forms AS (SELECT base, unnest(range(1, count(*) + 4)) AS i FROM f GROUP BY base), named AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS id FROM forms),
          free AS (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY i) AS n FROM named WHERE id NOT IN (SELECT id FROM taken) AND (i = 1 OR id NOT IN (SELECT base FROM f))) SELECT id FROM f JOIN free USING (base, n)""",
        "synthetic_corpus": f"""{draws}, f AS (SELECT ord, {pick(0, synthetic.SUBSYSTEMS)} AS s, {pick(1, synthetic.COMPONENTS)} AS c, {pick(2, synthetic.FAILURES)} AS f, {pick(3, synthetic.FIXES)} AS x, {pick(4, synthetic.TOOLS)} AS t, 1000 + CAST(floor(u[6] * 9000) AS BIGINT) AS e, 1024 + CAST(floor(u[7] * 60000) AS BIGINT) AS p FROM u)
          SELECT ord, 'syn_1337_' || ord AS key, sha256(format('The {{}}''s {{}} {{}}. Fix: {{}}. Diagnosed via {{}} on :{{}}; the failing call returns E{{}}. (synthetic distractor syn_1337_{{}})', s, c, f, x, t, p, e, ord)) AS text_key, s || ' ' || c || ' — ' || f[1:60] AS description FROM f""",
        "payload_merge": """WITH e AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS put, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS third, CASE WHEN event_id % 2 = 0 THEN event_type END AS even FROM events),
          b AS (SELECT id, max(seq) AS base FROM e WHERE put = 1 GROUP BY id) SELECT id, arg_max(k, seq) FILTER (k IS NOT NULL) AS k, arg_max(third, seq) FILTER (third IS NOT NULL) AS third, arg_max(even, seq) FILTER (even IS NOT NULL) AS even FROM e JOIN b USING (id) WHERE seq >= base GROUP BY id""",
        "event_counts": "SELECT user_id AS request, count(*) FILTER (event_type = 'view' AND event_id % 4 > 0) AS added, count(*) FILTER (event_type IN ('view', 'click')) AS stored FROM events GROUP BY user_id",
        "embedder_widths": """WITH s AS (SELECT vec_id AS mode, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE len(embedding) END AS native, ['none','discrete','continuous'][CAST(vec_id % 3 + 1 AS INT)] AS mrl,
            CASE WHEN vec_id % 2 = 0 THEN [len(embedding), 32] ELSE [len(embedding)] END AS trained, vec_id % 6 * 16 AS target,
            CASE WHEN vec_id % 5 = 0 THEN CASE WHEN vec_id % 4 = 0 THEN ' ' ELSE 'kept columns' END END AS reason, CASE WHEN vec_id % 7 = 0 THEN CASE WHEN vec_id % 4 = 1 THEN '' ELSE 'issue 1' END END AS tracked FROM embeddings),
          k AS (SELECT *, target = native OR (target > 0 AND target < native AND (mrl = 'continuous' OR (mrl = 'discrete' AND list_contains(trained, target)))) AS fits, reason IS NOT NULL OR tracked IS NOT NULL AS excused FROM s)
          SELECT mode, concat_ws('; ', CASE WHEN native <= 0 THEN 'native not positive' END, CASE WHEN target <= 0 THEN 'target not positive' END, CASE WHEN target > native THEN 'target over native' END,
            CASE WHEN NOT list_contains(trained, native) THEN 'native not trained' END, CASE WHEN mrl = 'none' AND len(trained) <> 1 THEN 'several widths trained without mrl' END, CASE WHEN NOT fits AND NOT excused THEN 'untrained target without reason' END,
            CASE WHEN fits AND excused THEN 'stale reason' END, CASE WHEN excused AND trim(coalesce(reason, '')) = '' THEN 'empty reason' END, CASE WHEN excused AND trim(coalesce(tracked, '')) = '' THEN 'empty tracked_by' END) AS problems FROM k""",
        "embed_known": f"WITH {C.FACTS} SELECT id, CAST(CASE WHEN coalesce(data, '') <> '' THEN 2 END AS INT) AS width, CASE WHEN coalesce(data, '') <> '' THEN sha256(left(data, 32000)) < '8' END AS was_known FROM facts",
    }
