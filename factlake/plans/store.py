"""Queries of the store's life cycle, its maintenance passes and its evaluation, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import entities
from factlake.functions import text as T
from factlake.operators import blocks as B
from factlake.operators import evaluation as E
from factlake.operators import extraction as X
from factlake.operators import lifecycle as L
from factlake.operators import rerank
from factlake.operators import retrieval as R
from factlake.plans import catalogue as C
from factlake.sources import facts as S

FLOORS = [0.0, 0.2, 0.3, 0.4, 0.6]


def _now():
    return F.lit(S.NOW).cast("timestamp")


def upsert_fold(spark, d):
    return L.fold(S.change_log(spark, d))


def delete_cascade(spark, d):
    vectors = S.vectors(spark, d).select(F.col("fact_id").alias("id"))
    return L.cascade(vectors, S.change_log(spark, d))


def validity_fold(spark, d):
    folded = L.validity(S.facts(spark, d), _now())
    return folded.select("id", "validity.valid_at", "validity.invalid_at", "validity.superseded_by", "validity.status")


def payload_equality(spark, d):
    return L.having(S.facts(spark, d), kind="feedback", scope="fr", state=None, ord=True).select("id", "kind", "scope")


def get_by_id(spark, d):
    return S.facts(spark, d).filter(F.col("id") == "77").select("id", "state", "kind", "entity_type", "superseded_by")


def list_kind_after_cap(spark, d):
    return L.capped(R.readable(S.facts(spark, d)), 100, "feedback").select("scope", "id")


def reembed_outcomes(spark, d):
    v = S.vectors(spark, d).withColumnRenamed("fact_id", "id")
    facts = S.facts(spark, d).join(v.withColumnRenamed("vector", "made"), "id", "left")
    facts = facts.withColumn("made", F.when(F.col("ord") % 6 != 0, F.col("made")))
    return L.reembed_outcomes(facts, v, v.filter("cast(id as long) % 3 = 1"), 64)


def mrl_truncate(spark, d):
    v = S.vectors(spark, d).select("fact_id", F.posexplode(L.truncate_vector(F.col("vector"), 16)).alias("place", "x"))
    return v.select("fact_id", "place", F.round("x", 6).alias("x"))


def _entities(spark, d):
    words = F.filter(F.split("data", "[ \\t-\\r]+"), lambda w: w != "")
    lead = F.get(F.array(*map(F.lit, ["the ", "", "genuine ", "of "])), (F.col("ord") % 4).cast("int"))
    span = F.concat(lead, F.array_join(F.slice(words, 1, F.col("ord").cast("int") % 4 + 1), " "))
    links = F.expr("case when ord % 5 = 0 then array() else array(ord, ord + 1, ord + ord % 50) end").cast("array<long>")
    return S.facts(spark, d).select("id", span.alias("entity"), F.array_distinct(links).alias("links"))


def entity_quality(spark, d):
    return _entities(spark, d).select("id", "entity", entities.low_quality(F.col("entity")).alias("junk"))


def _relinked(spark, d):
    return L.relink(_entities(spark, d).withColumn("junk", F.col("id").cast("long") % 3 == 0), 200)


def relink_affected(spark, d):
    return _relinked(spark, d)[0]


def relink_deletable(spark, d):
    return _relinked(spark, d)[1]


def topic_slug(spark, d):
    return S.facts(spark, d).select("id", T.slug(F.col("data")).alias("slug"))


def trigram_similarity_pairs(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.trigrams(F.col("text")).alias("g"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return b.join(after, "item_id").select("item_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


def upper_median(spark, d):
    return E.upper_medians(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value", "median")


def conversation_windows(spark, d):
    """Each conversation's messages in order, as the extractor gets them: whole windows of ten turns."""
    return X.windows(spark.read.parquet(f"{d}/conversations.parquet")).select("conv_id", "window", "n", F.sha2("text", 256).alias("text_key"))


def _holding(facts, asked):
    """query_id, key of the facts of a query's scopes that hold its whole text."""
    asked = R._scoped(asked)
    if R._small(asked, asked.count()):
        return B.holding(facts, asked)
    held = R._meet(facts.select("scope", "id", "data"), asked)
    return held.filter(F.contains("data", F.col("query"))).select("query_id", F.col("id").alias("key"))


def _gold(spark, d):
    """Gold queries, and what they expect: live facts of their scopes that hold their whole text."""
    asked = S.text_queries(spark, d)
    gold = asked.select("query_id", F.get(F.array(*map(F.lit, ["lexical-gap", "exact-identifier"])), (F.col("query_id") % 2).cast("int")).alias("class"))
    return gold, _holding(C._live(spark, d), asked)


def _judged(spark, d):
    """Gold queries, what they expect, and the lexical leg's ranking."""
    hits = R.ranked(R.lexical_leg(S.text_queries(spark, d), C._live(spark, d), 18), [F.desc(F.round("score", 9)), F.col("id")])
    return *_gold(spark, d), hits.select("query_id", F.col("id").alias("key"), "rank", "score")


def gold_outcomes(spark, d):
    out = E.outcomes(*_judged(spark, d))
    return out.select("query_id", "class", "n_expected", *[F.round(c, 6).alias(c) for c in ("p5", "r10", "rr", "top_score")], "hit", "raw_hits")


def gold_metrics_by_class(spark, d):
    out = E.by_class(E.outcomes(*_judged(spark, d)))
    return out.select("class", "n", *[F.round(c, 6).alias(c) for c in ("p5", "r10", "mrr", "fp", "median_top_score")])


def floor_sweep(spark, d):
    out = E.sweep(*_judged(spark, d), FLOORS)
    return out.select("floor", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def mmr_rerank(spark, d):
    hits = R.ranked(C._vectors(spark, d, 6), [F.desc(F.round("score", 9)), F.col("id")]).withColumnRenamed("id", "key")
    return rerank.diverse(hits.select("query_id", "key", "data", "score", "rank"), 0.5).select("query_id", "key", "rank", F.round("score", 6).alias("score"))


_ALL = (upsert_fold, delete_cascade, validity_fold, payload_equality, get_by_id, list_kind_after_cap, reembed_outcomes, mrl_truncate, entity_quality, relink_affected, relink_deletable, topic_slug, trigram_similarity_pairs, upper_median, conversation_windows, gold_outcomes, gold_metrics_by_class, floor_sweep, mmr_rerank)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    facts, (_, _, lex) = C.FACTS, C.lexical_sql()
    log = """log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, props AS payload, ts AS moment, CAST(event_id AS VARCHAR) AS cause,
      CASE event_type WHEN 'error' THEN 'invalidate' WHEN 'purchase' THEN 'delete' ELSE 'upsert' END AS op FROM events),
    since AS (SELECT * FROM log WHERE op <> 'delete' AND seq > coalesce((SELECT max(seq) FROM log g WHERE g.id = log.id AND g.op = 'delete'), -1)),
    begun AS (SELECT id, arg_min(moment, seq) AS created_at, arg_max(payload, seq) AS payload, min(seq) AS first FROM since WHERE op = 'upsert' GROUP BY id)"""
    span = """ents AS (SELECT id, ord, ['the ','','genuine ','of '][CAST(ord % 4 + 1 AS INT)] ||
      array_to_string(list_filter(string_split_regex(data, '[ \\t-\\r]+'), lambda w: w <> '')[1:CAST(ord % 4 + 1 AS INT)], ' ') AS entity,
      CASE WHEN ord % 5 = 0 THEN [] ELSE [ord, ord + 1, ord + ord % 50] END AS links FROM facts)"""
    edges = f"WITH {facts}, {span}, edges AS (SELECT DISTINCT id, unnest(links) AS fact FROM ents WHERE ord % 3 = 0), affected AS (SELECT DISTINCT fact FROM edges ORDER BY fact LIMIT 200)"
    quoted = lambda words: ",".join(f"'{w}'" for w in words)
    stop, clause, gerund, vague = (quoted(w) for w in (entities.STOP, entities.CLAUSE, entities.GERUNDS, entities.VAGUE))
    junk = f"""WITH {facts}, {span}, low AS (SELECT id, entity, regexp_replace(trim(lower(entity)), '^(?:the|a|an)\\s+', '') AS t FROM ents),
    ws AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '') AS w FROM low),
    parts AS (SELECT *, len(w) AS n, w[1] AS f, w[-1] AS l FROM ws)
    SELECT id, entity, n < 2 OR f IN ({stop}) OR l IN ({stop}) OR regexp_matches(t, '[`"|()\\[\\]{{}}+,;:!?<>—–]') OR len(list_filter(w, lambda x: x IN ({clause}))) > 0
      OR (n >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '[''’]s$'))) > 0) OR (length(f) >= 8 AND f LIKE '%ing' AND f NOT IN ({gerund}))
      OR (n >= 3 AND f IN ({vague}) AND len(list_filter(w[2:], lambda x: length(x) >= 5 AND regexp_matches(x, '{entities.NOMINAL}'))) > 0 AND l LIKE '%s' AND NOT regexp_matches(l, '{entities.NO_PLURAL}'))
      OR len(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({stop}) AND regexp_matches(x, '[a-z]'))) = 0 AS junk FROM parts"""
    gram = "CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) END"
    judged = f"""WITH {facts}{lex}, gold AS (SELECT item_id AS query_id, text, ['lexical-gap','exact-identifier'][CAST(item_id % 2 + 1 AS INT)] AS class FROM benchmark),
    expected AS (SELECT query_id, id AS key FROM gold JOIN live ON scope IN ('en','fr','de','es') AND contains(data, text)),
    hits AS (SELECT query_id, id AS key, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, id) AS rank FROM lexleg),
    outs AS (SELECT query_id, class, (SELECT count(*) FROM expected e WHERE e.query_id = gold.query_id) AS n_expected,
      (SELECT count(*) FROM hits SEMI JOIN expected USING (query_id, key) WHERE query_id = gold.query_id AND rank <= 5) AS near,
      (SELECT count(*) FROM hits SEMI JOIN expected USING (query_id, key) WHERE query_id = gold.query_id AND rank <= 10) AS far,
      coalesce((SELECT 1.0::DOUBLE / min(rank) FROM hits SEMI JOIN expected USING (query_id, key) WHERE query_id = gold.query_id), 0) AS rr,
      (SELECT count(*) FROM hits h WHERE h.query_id = gold.query_id) AS raw_hits, (SELECT max(score) FROM hits h WHERE h.query_id = gold.query_id) AS top_score FROM gold)"""
    metrics = """count(*) AS n, round(coalesce(avg(near / 5.0::DOUBLE) FILTER (n_expected > 0), 0), 6) AS p5, round(coalesce(avg(far / n_expected::DOUBLE) FILTER (n_expected > 0), 0), 6) AS r10,
      round(coalesce(avg(rr) FILTER (n_expected > 0), 0), 6) AS mrr, round(avg((raw_hits > 0)::INT::DOUBLE) FILTER (n_expected = 0), 6) AS fp, round(-quantile_disc(-top_score, 0.5), 6) AS median_top_score"""
    return {
        "upsert_fold": f"WITH {log} SELECT id, payload, created_at, (SELECT arg_min(moment, seq) FROM since s WHERE s.id = begun.id AND op = 'invalidate' AND seq > first) AS invalid_at, (SELECT arg_min(cause, seq) FROM since s WHERE s.id = begun.id AND op = 'invalidate' AND seq > first) AS superseded_by FROM begun",
        "delete_cascade": f"WITH {log}, ends AS (SELECT id, arg_max(op, seq) AS op FROM log WHERE op <> 'invalidate' GROUP BY id) SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM ends WHERE op = 'delete')",
        "validity_fold": f"WITH {facts} SELECT id, valid_at, invalid_at, superseded_by, CASE WHEN coalesce(CAST(valid_at AS VARCHAR), CAST(invalid_at AS VARCHAR), superseded_by) IS NOT NULL THEN CASE WHEN invalid_at <= TIMESTAMP '2024-03-01' THEN 'superseded' ELSE 'current' END END AS status FROM facts",
        "payload_equality": f"WITH {facts} SELECT id, kind, scope FROM facts WHERE kind = 'feedback' AND scope = 'fr'",
        "get_by_id": f"WITH {facts} SELECT id, state, kind, entity_type, superseded_by FROM facts WHERE id = '77'",
        "list_kind_after_cap": f"WITH {facts}, capped AS (SELECT * FROM readable QUALIFY row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) <= 100) SELECT scope, id FROM capped WHERE kind = 'feedback'",
        "reembed_outcomes": f"WITH {facts} SELECT CASE WHEN coalesce(data, '') = '' THEN 'skipped' WHEN ord % 6 = 0 OR len(embedding) <> 64 THEN 'error' ELSE 'reembedded' END AS outcome, count(*) AS n FROM facts JOIN embeddings ON ord = vec_id WHERE vec_id % 3 <> 1 GROUP BY 1",
        "mrl_truncate": "WITH h AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM h) SELECT CAST(vec_id AS VARCHAR) AS fact_id, CAST(unnest(range(len(v))) AS INT) AS place, round(unnest(list_transform(v, lambda x: x / norm)), 6) AS x FROM s",
        "entity_quality": junk,
        "relink_affected": f"{edges} SELECT fact FROM affected",
        "relink_deletable": f"{edges} SELECT id FROM edges GROUP BY id HAVING bool_and(fact IN (SELECT fact FROM affected))",
        "topic_slug": f"WITH {facts}, s AS (SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(data), '[^a-z0-9\\s_-]', ' ', 'g'), '[\\s_-]+'), lambda w: w <> '')[1:7], '_') AS slug FROM facts) SELECT id, CASE WHEN slug = '' THEN 'memory' ELSE slug END AS slug FROM s",
        "trigram_similarity_pairs": f"WITH s AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s FROM benchmark), g AS (SELECT item_id, {gram} AS g FROM s) SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE, 6) AS similarity FROM g a JOIN g b ON b.item_id = a.item_id + 1",
        "mmr_rerank": f"""{C.VECTOR.replace("<= 8)", "<= 6)")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cosleg),
          flat AS (SELECT *, lower(trim(regexp_replace(data, '\\s+', ' ', 'g'))) AS s FROM ranked), hits AS (SELECT query_id, id, score, rank, {gram} AS g, greatest(max(score) OVER (PARTITION BY query_id), 0) AS top FROM flat),
          sims AS (SELECT a.query_id, a.rank AS rank, b.rank AS other, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.rank <> b.rank),
          near AS (SELECT query_id, rank, other, coalesce(shared / nullif(total - shared, 0)::DOUBLE, 0) AS sim FROM sims),
          chosen AS (WITH RECURSIVE steps AS (SELECT DISTINCT query_id, CAST([] AS BIGINT[]) AS taken FROM hits
            UNION ALL SELECT query_id, list_append(taken, rank) FROM (SELECT query_id, taken, rank, row_number() OVER (PARTITION BY query_id ORDER BY 0.5::DOUBLE * score / CASE WHEN top = 0 THEN 1 ELSE top END - 0.5::DOUBLE * nearest DESC, rank) AS o
              FROM (SELECT s.query_id, s.taken, h.rank, h.score, h.top, coalesce(max(n.sim), 0) AS nearest FROM steps s JOIN hits h ON h.query_id = s.query_id AND NOT list_contains(s.taken, h.rank)
                LEFT JOIN near n ON n.query_id = h.query_id AND n.rank = h.rank AND list_contains(s.taken, n.other) GROUP BY ALL)) WHERE o = 1)
            SELECT query_id, arg_max(taken, len(taken)) AS taken FROM steps GROUP BY query_id)
          SELECT query_id, id AS key, CAST(list_position(taken, rank) AS BIGINT) AS rank, round(score, 6) AS score FROM hits JOIN chosen USING (query_id)""",
        "upper_median": "SELECT event_type, -quantile_disc(-value, 0.5) AS median FROM events GROUP BY event_type",
        "conversation_windows": "SELECT conv_id, turn // 10 AS \"window\", count(*) AS n, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_key FROM conversations GROUP BY 1, 2",
        "gold_outcomes": f"{judged} SELECT query_id, class, n_expected, round(near / 5.0::DOUBLE, 6) AS p5, CASE WHEN n_expected > 0 THEN round(far / n_expected::DOUBLE, 6) END AS r10, round(rr, 6) AS rr, round(top_score, 6) AS top_score, near > 0 AS hit, raw_hits FROM outs",
        "gold_metrics_by_class": f"{judged} SELECT class, {metrics} FROM outs GROUP BY class UNION ALL SELECT 'overall', {metrics} FROM outs WHERE n_expected > 0",
        "floor_sweep": f"""{judged}, fl AS (SELECT unnest({FLOORS})::DOUBLE AS floor), o AS (SELECT floor, n_expected,
          (SELECT count(*) FROM hits SEMI JOIN expected USING (query_id, key) WHERE query_id = outs.query_id AND rank <= 5 AND score >= floor) > 0 AS hit, coalesce(top_score >= floor, false) AS raw FROM outs, fl),
        c AS (SELECT floor, count(*) FILTER (n_expected > 0 AND hit) AS tp, count(*) FILTER (n_expected = 0 AND raw) AS fp, count(*) FILTER (n_expected > 0 AND NOT hit) AS fn FROM o GROUP BY floor),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS q FROM c)
        SELECT floor, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r""",
    }
