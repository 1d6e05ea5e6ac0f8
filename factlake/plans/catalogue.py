"""The engine's queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators import evaluation as E
from factlake.operators import retrieval as R
from factlake.sources import facts as S

AS_OF = "2024-01-20 12:00:00"

FACTS = """
facts AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, text AS data, source AS name, lang AS scope,
  ['project','feedback','reference','user'][CAST(doc_id % 4 + 1 AS INT)] AS kind,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id + doc_id % 29 * 24 AS INT)) END AS updated_at,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT) - 24) END AS valid_at,
  CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT) + 720) END AS invalid_at,
  CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id + 1 AS VARCHAR) END AS superseded_by,
  CASE WHEN doc_id % 13 = 0 THEN 'archived' ELSE 'active' END AS state, CASE WHEN doc_id % 11 = 0 THEN 'COMPOUND' END AS entity_type FROM documents),
readable AS (SELECT * FROM facts WHERE entity_type IS NULL AND state <> 'archived'),
live AS (SELECT * FROM readable WHERE invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-03-01')"""
VECTOR = f"""WITH {FACTS}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, unnest(['en','fr','de','es']) AS scope FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, f.scope, id, ord, data, created_at, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS score
  FROM live f JOIN embeddings e ON f.ord = e.vec_id JOIN q ON q.scope = f.scope),
cosleg AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) <= 8)"""


def _live(spark, d):
    return R.readable(S.facts(spark, d), R.current(S.NOW))


def _vectors(spark, d, limit=8):
    return R.vector_leg(S.vector_queries(spark, d), _live(spark, d), S.vectors(spark, d), limit)


def vec_topk_scoped(spark, d):
    return _vectors(spark, d).select("query_id", "scope", "id", F.round("score", 6).alias("score"))


def vec_topk_multiscope_merge(spark, d):
    return R.merge_scopes(_vectors(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


def vec_floor_abs(spark, d):
    return R.floor(_vectors(spark, d), least=0.2).select("query_id", "id", F.round("score", 6).alias("score"))


def vec_floor_ratio(spark, d):
    return R.floor(_vectors(spark, d), ratio=0.6).select("query_id", "id", F.round("score", 6).alias("score"))


def vec_decay_order(spark, d):
    hits = _vectors(spark, d).withColumn("weighted", F.round(F.col("score") * R.recency(F.col("created_at"), S.NOW), 9))
    return R.ranked(hits, [F.desc("weighted"), F.col("id")]).select("query_id", "id", "rank", F.round("weighted", 6).alias("weighted"))


def lex_tokens(spark, d):
    return S.text_queries(spark, d).select("query_id", F.posexplode(T.lexical_tokens(F.col("query"))).alias("place", "token"))


def lex_tokens_file(spark, d):
    return S.text_queries(spark, d).select("query_id", F.explode(T.file_tokens(F.col("query"))).alias("token"))


def lex_score_topk(spark, d):
    return R.lexical_leg(S.text_queries(spark, d), _live(spark, d), 18).select("query_id", "scope", "id", F.round("score", 6).alias("score"))


def _legs(spark, d, linked=False):
    """Both legs for the text queries, with names for texts, and their texts; a query's vector is that of the same number. linked: the lexical leg's facts have links."""
    asked = S.text_queries(spark, d)
    v = S.vectors(spark, d)
    with_vector = asked.join(v.select(F.col("fact_id").cast("long").alias("query_id"), "vector"), "query_id")
    order = [F.desc(F.round("score", 9)), F.col("id")]
    none = F.lit(None).cast("string")
    cos = R.ranked(R.vector_leg(with_vector, _live(spark, d), v, 8, texts=False), order, "place").drop("ord").withColumnRenamed("place", "ord").withColumn("link_id", none)
    facts = R.readable(S.linked_facts(spark, d), R.current(S.NOW)) if linked else _live(spark, d).withColumn("link_id", none)
    lex = R.ranked(R.lexical_leg(asked, facts, 18, texts=False), order, "place").drop("ord").withColumnRenamed("place", "ord")
    (cos, near), (lex, worded) = R.named(cos, _live(spark, d)), R.named(lex, facts)
    return cos, lex, near.unionByName(worded)


def _fuse(legs, **options):
    cos, lex, texts = legs
    return R.fuse(cos, lex, texts=texts, **options)


def _fused(spark, d, **options):
    return _fuse(_legs(spark, d), **options).select("query_id", "key", "cosine_rank", "lexical_rank", F.round("score", 9).alias("score"), "rank")


def fuse_floored_union(spark, d):
    return _fused(spark, d)


def fuse_cosine_gated(spark, d):
    return _fused(spark, d, gated=True)


def fuse_lex_weight(spark, d):
    return _fused(spark, d, weight=2.0, least_lexical=0.1)


def fuse_links(spark, d):
    """Projections count for the facts that they are linked to, under whatever text."""
    out = _fuse(_legs(spark, d, linked=True), least_lexical=0.1)
    return out.select("query_id", "key", "cosine_rank", "lexical_rank", F.round("score", 9).alias("score"), "rank")


def hybrid_topk(spark, d):
    return _fused(spark, d).filter("rank <= 6")


def list_page(spark, d):
    rows = R.readable(S.facts(spark, d)).withColumn("query_id", F.col("scope"))
    return R.ranked(rows, [F.desc("created_at"), F.col("id")]).filter("rank <= 100").select("scope", "id", "rank")


def list_total(spark, d):
    return R.readable(S.facts(spark, d)).groupBy("scope").agg(F.count(F.lit(1)).alias("total"))


def asof_snapshot(spark, d):
    return R.readable(S.facts(spark, d), R.as_of(AS_OF)).select("id", "kind")


def include_superseded(spark, d):
    return R.readable(S.facts(spark, d)).select("id", "superseded_by")


def archived_exclusion(spark, d):
    return S.facts(spark, d).filter("state <> 'archived'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def kind_segregation(spark, d):
    return S.facts(spark, d).groupBy(F.col("entity_type").isNotNull().alias("is_entity")).agg(F.count(F.lit(1)).alias("n"))


def reembed_delta(spark, d):
    facts = S.facts(spark, d)
    return facts.join(S.vectors(spark, d).select(F.col("fact_id").alias("id")), "id", "left_anti").select("id")


def kind_to_type(spark, d):
    return S.facts(spark, d).select("id", T.type_for_kind(F.col("kind")).alias("type"))


def embed_dedupe(spark, d):
    return S.facts(spark, d).groupBy(F.sha2("data", 256).alias("text_key")).agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return counts.join(E.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")


_ALL = (vec_topk_scoped, vec_topk_multiscope_merge, vec_floor_abs, vec_floor_ratio, vec_decay_order, lex_tokens, lex_tokens_file, lex_score_topk, fuse_floored_union, fuse_cosine_gated, fuse_lex_weight, fuse_links, hybrid_topk, list_page, list_total, asof_snapshot, include_superseded, archived_exclusion, kind_segregation, reembed_delta, kind_to_type, embed_dedupe, latency_percentiles)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def lexical_sql() -> tuple[str, str, str]:
    """Common table expressions of the text queries' words, their tokens, and the lexical leg (which holds the others)."""
    split = "list_filter(string_split_regex(lower({}), '[^a-z0-9_-]+'), lambda x: length(x) >= 2)"
    parts = "list_filter(flatten(list_transform(list_filter(w, lambda x: regexp_matches(x, '[_-]')), lambda x: string_split_regex(x, '[_-]+'))), lambda x: length(x) >= 2)"
    words = f"asked AS (SELECT item_id AS query_id, text, {split.format('text')} AS w FROM benchmark), longer AS (SELECT query_id, list_concat(w, {parts}) AS w FROM asked)"
    distinct = "toks AS (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:32] AS tokens FROM longer)"
    lex = f""", {words}, {distinct}, pairs AS (SELECT t.query_id, f.scope, id, created_at, data, len(tokens) AS n,
      list_sum(list_transform(tokens, lambda x: CASE WHEN contains(lower(name), x) THEN 3 WHEN contains(lower(data), x) THEN 1 ELSE 0 END)) AS raw
      FROM live f, toks t WHERE f.scope IN ('en','fr','de','es') AND len(tokens) > 0),
    lexleg AS (SELECT query_id, scope, id, data, raw / (3.0 * n) AS score FROM pairs WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY raw DESC, created_at DESC, id) <= 18)"""
    return words, distinct, lex


def fused_sql(bar=0.3, weight="1.0", join="FULL") -> str:
    """Both legs of the text queries and their fusion."""
    _, _, lex = lexical_sql()
    legs = f"""WITH {FACTS}{lex}, q AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v, unnest(['en','fr','de','es']) AS scope FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id),
    cosleg AS (SELECT query_id, f.scope, id, data, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS score FROM live f JOIN embeddings e ON f.ord = e.vec_id JOIN q ON q.scope = f.scope
      QUALIFY row_number() OVER (PARTITION BY query_id, f.scope ORDER BY score DESC, id) <= 8),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM cosleg),
    alias AS (SELECT query_id, nt, arg_min(id, o) AS target FROM c WHERE nt <> '' GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS o, trim(regexp_replace(data, '\\s+', ' ', 'g')) AS nt FROM lexleg WHERE score >= {{bar}}),
    lk AS (SELECT l.query_id, coalesce(target, l.nt) AS key, min(o) AS lexical_rank FROM l LEFT JOIN alias a ON a.query_id = l.query_id AND a.nt = l.nt WHERE coalesce(target, l.nt) <> '' GROUP BY ALL),
    f AS (SELECT coalesce(c.query_id, lk.query_id) AS query_id, coalesce(c.id, lk.key) AS key, o AS cosine_rank, lexical_rank, coalesce(1.0 / (60 + o), 0) + coalesce({{weight}} / (60 + lexical_rank), 0) AS score
      FROM c {{join}} JOIN lk ON c.query_id = lk.query_id AND c.id = lk.key),
    out AS (SELECT query_id, key, cosine_rank, lexical_rank, round(CAST(score AS DOUBLE), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine_rank NULLS LAST, lexical_rank) AS rank FROM f)
    SELECT * FROM out"""
    return legs.format(bar=bar, weight=f"CAST({weight} AS DOUBLE)", join=join).replace("coalesce(1.0 /", "coalesce(CAST(1 AS DOUBLE) /")


def oracle_sql() -> dict[str, str]:
    words, distinct, lex = lexical_sql()
    fused, link = fused_sql, "CASE WHEN CAST(l.id AS BIGINT) % 3 = 0 THEN CAST(CAST(l.id AS BIGINT) + 3 - CAST(l.id AS BIGINT) % 6 * 2 AS VARCHAR) END"
    return {
        "vec_topk_scoped": f"{VECTOR} SELECT query_id, scope, id, round(score, 6) AS score FROM cosleg",
        "vec_topk_multiscope_merge": f"{VECTOR} SELECT query_id, id, round(max(score), 6) AS score FROM cosleg GROUP BY query_id, id",
        "vec_floor_abs": f"{VECTOR} SELECT query_id, id, round(score, 6) AS score FROM cosleg WHERE score >= 0.2",
        "vec_floor_ratio": f"{VECTOR} SELECT query_id, id, round(score, 6) AS score FROM cosleg QUALIFY score >= 0.6 * max(score) OVER (PARTITION BY query_id)",
        "vec_decay_order": f"{VECTOR}, w AS (SELECT query_id, id, round(score * (0.9 + 0.1 * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(created_at)) / 86400000000.0) / 30.0)), 9) AS weighted FROM cosleg) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, id) AS rank, round(weighted, 6) AS weighted FROM w",
        "lex_tokens": f"WITH {words}, {distinct} SELECT query_id, CAST(unnest(range(len(tokens))) AS INT) AS place, unnest(tokens) AS token FROM toks",
        "lex_tokens_file": "SELECT DISTINCT query_id, token FROM (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token FROM benchmark) WHERE length(token) >= 2",
        "lex_score_topk": f"WITH {FACTS}{lex} SELECT query_id, scope, id, round(CAST(score AS DOUBLE), 6) AS score FROM lexleg",
        "fuse_floored_union": fused(),
        "fuse_cosine_gated": fused(join="LEFT"),
        "fuse_lex_weight": fused(0.1, "2.0"),
        "fuse_links": fused(0.1).replace("LEFT JOIN alias a ON a.query_id = l.query_id AND a.nt = l.nt WHERE coalesce(target, l.nt)", f"LEFT JOIN alias a ON a.query_id = l.query_id AND a.nt = l.nt LEFT JOIN (SELECT query_id AS cq, id AS ci FROM c) k ON cq = l.query_id AND ci = {link} WHERE coalesce(ci, target, {link}, l.nt)").replace("coalesce(target, l.nt) AS key, min(o)", f"coalesce(ci, target, {link}, l.nt) AS key, min(o)"),
        "hybrid_topk": fused() + " WHERE rank <= 6",
        "list_page": f"WITH {FACTS} SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) AS rank FROM readable QUALIFY rank <= 100",
        "list_total": f"WITH {FACTS} SELECT scope, count(*) AS total FROM readable GROUP BY scope",
        "asof_snapshot": f"WITH {FACTS} SELECT id, kind FROM readable WHERE coalesce(valid_at, created_at) <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}')",
        "include_superseded": f"WITH {FACTS} SELECT id, superseded_by FROM readable",
        "archived_exclusion": f"WITH {FACTS} SELECT kind, count(*) AS n FROM facts WHERE state <> 'archived' GROUP BY kind",
        "kind_segregation": f"WITH {FACTS} SELECT entity_type IS NOT NULL AS is_entity, count(*) AS n FROM facts GROUP BY 1",
        "reembed_delta": f"WITH {FACTS} SELECT id FROM facts WHERE ord NOT IN (SELECT vec_id FROM embeddings)",
        "kind_to_type": f"WITH {FACTS} SELECT id, CASE kind WHEN 'user' THEN 'user' WHEN 'feedback' THEN 'feedback' WHEN 'reference' THEN 'reference' ELSE 'project' END AS type FROM facts",
        "embed_dedupe": f"WITH {FACTS} SELECT sha256(data) AS text_key, count(*) AS n FROM facts GROUP BY 1",
        "latency_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY event_type",
    }
