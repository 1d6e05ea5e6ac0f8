"""Queries of the write path, of seeded corpora and of what is read from JSON payloads, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import embedding as M
from factlake.operators import retrieval as R
from factlake.operators import writing as W
from factlake.plans import catalogue as C
from factlake.sources import facts as S

MODELS = ["gemma", "qwen3", "harrier", "granite"]


def _vector_rows(vectors):
    return vectors.select("fact_id", F.size("vector").alias("width"), F.round(F.element_at("vector", 1), 6).alias("x"))


def vector_upsert(spark, d):
    """Every third vector written again backwards, every seventh of these too short."""
    v, n = S.vectors(spark, d), F.col("fact_id").cast("long")
    made = v.filter(n % 3 == 0).withColumn("vector", F.when(n % 7 == 0, F.slice("vector", 2, 3)).otherwise(F.reverse("vector")))
    return _vector_rows(W.upsert_vectors(v, made, S.facts(spark, d), 64))


def reembed_vectors(spark, d):
    """Vectors of two numbers for facts that have none among every third; texts of some lengths fail."""
    v = S.vectors(spark, d)
    size = lambda t: F.length(t).cast("double")
    made = lambda t: F.when(F.length(t) % 6 != 0, F.array(size(t), F.lit(1.0)))
    return _vector_rows(W.reembed(S.facts(spark, d), v, v.filter("cast(fact_id as long) % 3 = 1"), made, 2))


def projection_write(spark, d):
    """Copies of the facts in a second store."""
    return W.project(S.facts(spark, d), F.concat(F.lit("p_"), "id")).select("id", "link_id", "scope", "kind")


def projection_cleanup(spark, d):
    """Linked facts that are left when every fifth fact and its copies go."""
    f = S.facts(spark, d)
    copies = S.linked_facts(spark, d).filter("link_id is not null")
    return W.forget_projections(copies, f, f.filter("ord % 5 = 0")).select("id", "link_id", "scope")


def _seeded(spark, d):
    f = S.facts(spark, d)
    return W.seed(f.select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("ord") % 4 == 0, "  ").otherwise(F.col("data")).alias("text"), "kind", F.when(F.col("ord") % 3 > 0, F.col("name")).alias("description")), "bench")


def seed_manifest(spark, d):
    s = _seeded(spark, d)
    return W.manifest(s).withColumnRenamed("key", "entry").join(s.select(F.col("key").alias("entry"), F.get_json_object("metadata", "$.corpus_key").alias("corpus_key"), F.get_json_object("metadata", "$.description").alias("description")), "entry")


def unseed_corpus(spark, d):
    """Facts that stay when the even half of a seeding goes."""
    s = _seeded(spark, d)
    even = W.manifest(s).filter(F.substring("key", 2, 20).cast("long") % 2 == 0)
    return W.unseed(s.filter("id is not null"), even).select("id", "scope", "kind")


def _payloads(spark, d):
    """The facts with JSON payloads that lack some keys and hold numbers at others."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    data = F.when(F.col("ord") % 9 == 0, F.col("ord").cast("string")).otherwise(quoted(F.col("name")))
    kind = F.when(F.col("ord") % 7 == 0, "7").otherwise(quoted(F.col("kind")))
    rest = F.when(F.col("ord") % 10 == 0, "").otherwise(F.concat(F.lit(',"kind":'), kind, F.lit(',"n":'), F.col("ord").cast("string")))
    return S.facts(spark, d).select("id", "ord", "scope", "created_at", F.concat(F.lit('{"data":'), data, F.lit(',"user_id":'), quoted(F.col("scope")), rest, F.lit("}")).alias("payload"))


def entry_projection(spark, d):
    return W.entries(_payloads(spark, d))


def payload_filter(spark, d):
    return W.having_payload(_payloads(spark, d), **{"kind": "feedback", "user-_id": "fr", "n": None, "data": True}).select("id", "scope")


def payload_times(spark, d):
    """When facts last changed, from payloads whose first key may be absent or no time."""
    iso = F.date_format(F.col("created_at") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss")
    first = F.when(F.col("ord") % 3 == 0, F.concat(F.lit('"updated_at":"'), iso, F.lit('",'))).when(F.col("ord") % 3 == 1, '"updated_at":"never",').otherwise("")
    last = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('"created_at":'), F.unix_millis("created_at").cast("string"))).otherwise(F.concat(F.lit('"createdAt":"'), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit('"')))
    return S.facts(spark, d).select("id", W.changed_at(F.concat(F.lit("{"), first, last, F.lit("}"))).alias("changed_at"))


def embed_prompts(spark, d):
    asked = S.text_queries(spark, d).select("query_id", "query")
    shapes = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("kind"), F.sha2(M.prompt(m, k, F.col("query")), 256).alias("text_key")) for m in MODELS for k in ("query", "document")]
    return asked.select("query_id", F.inline(F.array(*shapes)))


def gold_ranked_keys(spark, d):
    """The nearest facts by their sources as keys, which every sixth fact lacks."""
    hits = R.ranked(C._vectors(spark, d), [F.desc(F.round("score", 9)), F.col("id")]).select("query_id", "id", "rank", "score")
    keys = S.facts(spark, d).select("id", F.when(F.col("ord") % 6 > 0, F.col("name")).alias("key"))
    return W.ranked_keys(hits.join(keys, "id")).select("query_id", "key", "rank")


def get_by_ids(spark, d):
    """Facts that the benchmark's items name by number, entities and archived ones left out."""
    wanted = S.text_queries(spark, d).select(F.col("query_id").cast("string").alias("id"))
    return R.readable(S.facts(spark, d)).join(wanted, "id", "left_semi").select("id", "kind", "scope")


_ALL = (vector_upsert, reembed_vectors, projection_write, projection_cleanup, seed_manifest, unseed_corpus, entry_projection, payload_filter, payload_times, embed_prompts, gold_ranked_keys, get_by_ids)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    facts = C.FACTS
    seeded = f"""WITH {facts}, s AS (SELECT ord, 'k' || id AS entry, kind, CASE WHEN ord % 4 = 0 THEN '  ' ELSE data END AS t, CASE WHEN ord % 3 > 0 THEN name END AS d FROM facts),
    seeded AS (SELECT *, CASE WHEN trim(coalesce(t, '')) <> '' THEN md5('bench' || chr(10) || entry || chr(10) || t) END AS id FROM s)"""
    before = {("gemma", "query"): "task: search result | query: ", ("gemma", "document"): "title: none | text: ", ("qwen3", "query"): f"Instruct: {M.TASK}\nQuery:", ("harrier", "query"): f"Instruct: {M.TASK}\nQuery: "}
    shapes = ", ".join(f"('{m}', '{k}', '{before.get((m, k), '')}')" for m in MODELS for k in ("query", "document"))
    return {
        "vector_upsert": "SELECT CAST(vec_id AS VARCHAR) AS fact_id, CAST(len(embedding) AS INT) AS width, round(CAST(CASE WHEN vec_id % 3 = 0 AND vec_id % 7 <> 0 AND vec_id IN (SELECT doc_id FROM documents) THEN embedding[len(embedding)] ELSE embedding[1] END AS DOUBLE), 6) AS x FROM embeddings",
        "reembed_vectors": """SELECT CAST(vec_id AS VARCHAR) AS fact_id, CAST(len(embedding) AS INT) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings WHERE vec_id % 3 = 1
          UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(2 AS INT), CAST(length(left(text, 32000)) AS DOUBLE) FROM documents JOIN embeddings ON doc_id = vec_id WHERE vec_id % 3 <> 1 AND text <> '' AND length(left(text, 32000)) % 6 <> 0""",
        "projection_write": f"WITH {facts} SELECT 'p_' || id AS id, id AS link_id, scope, kind FROM facts",
        "projection_cleanup": f"""WITH {facts}, p AS (SELECT *, CAST(ord + 3 - ord % 6 * 2 AS VARCHAR) AS link_id FROM facts WHERE ord % 3 = 0)
          SELECT id, link_id, scope FROM p WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.id = p.link_id AND f.scope = p.scope AND f.ord % 5 = 0)""",
        "seed_manifest": f"{seeded} SELECT entry, id, id IS NULL AS failed, entry AS corpus_key, nullif(d, '') AS description FROM seeded",
        "unseed_corpus": f"{seeded} SELECT id, 'bench' AS scope, kind FROM seeded WHERE id IS NOT NULL AND ord % 2 = 1",
        "entry_projection": f"""WITH {facts} SELECT id, CASE WHEN ord % 9 = 0 THEN id ELSE coalesce(name, '') END AS text, CASE WHEN ord % 10 > 0 AND ord % 7 > 0 THEN kind END AS kind, scope,
          CASE WHEN ord % 10 > 0 THEN '{{"kind":' || CASE WHEN ord % 7 = 0 THEN '7' ELSE '"' || kind || '"' END || ',"n":' || id || '}}' END AS metadata FROM facts""",
        "payload_filter": f"WITH {facts} SELECT id, scope FROM facts WHERE ord % 10 > 0 AND ord % 7 > 0 AND kind = 'feedback' AND scope = 'fr'",
        "payload_times": f"WITH {facts} SELECT id, CASE WHEN ord % 3 = 0 THEN created_at + to_hours(1) ELSE created_at END AS changed_at FROM facts",
        "embed_prompts": f"SELECT item_id AS query_id, model, kind, sha256(lead || text) AS text_key FROM benchmark, (VALUES {shapes}) v(model, kind, lead)",
        "gold_ranked_keys": f"""{C.VECTOR}, h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cosleg),
          k AS (SELECT query_id, name AS key, min(rank) AS place FROM h JOIN facts USING (id) WHERE ord % 6 > 0 AND name IS NOT NULL GROUP BY ALL) SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank FROM k""",
        "get_by_ids": f"WITH {facts} SELECT id, kind, scope FROM readable WHERE ord IN (SELECT item_id FROM benchmark)",
    }
