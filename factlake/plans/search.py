"""Queries of approximate search, of floors and gold runs over both legs, and of falling back between legs, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import ann
from factlake.operators import engine as N
from factlake.operators import evaluation as E
from factlake.operators import retrieval as R
from factlake.operators import writing as W
from factlake.plans import catalogue as C
from factlake.plans import engine as G
from factlake.plans import store as L
from factlake.sources import facts as S
from factlake.sources import folders, topics

FLOORS = [0.0, 0.1, 0.2, 0.3]
#: Characters of a query beyond which the store's leg refuses it.
MOST_CHARS = 300


def ann_hits(spark, d, limit=8):
    vectors = S.vectors(spark, d)
    index = ann.fit(vectors)
    return ann.search(S.vector_queries(spark, d), C._live(spark, d), ann.assign(vectors, index), index, limit)


def ann_topk_scoped(spark, d):
    """Hits that the approximate search returns by query and scope: as many as asked for wherever so many rows are eligible."""
    return ann_hits(spark, d).groupBy("query_id", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def _options(floor=None):
    return N.SearchOptions(limit=8, depth=18, fusion_mode="floored-union", least_score=floor)


def _gold(spark, d):
    """Gold queries by class, and the live facts that hold a query's whole text, which it expects."""
    asked = S.text_queries(spark, d)
    expected = folders.kept(L._holding(C._live(spark, d), asked), "expected")
    some = expected.select("query_id").distinct().withColumn("some", F.lit(True))
    kinds = F.get(F.array(*map(F.lit, ["lexical-gap", "exact-identifier"])), (F.col("query_id") % 2).cast("int"))
    return asked.select("query_id").join(some, "query_id", "left").select("query_id", F.when(F.col("some"), kinds).otherwise("hard-negative").alias("class")), expected


def hybrid_floor_sweep(spark, d):
    """Quality of whole searches at several floors, which cut the cosine leg before recency, ranks and fusion."""
    hits = N.at_floors(G._query_table(spark, d), S.facts(spark, d), S.vectors(spark, d), S.NOW, FLOORS, _options())
    keyed = hits.select(F.struct("query_id", "floor").alias("query_id"), F.col("id").alias("key"), "rank", "score")
    ranked = W.ranked_keys(keyed).select("query_id.query_id", "query_id.floor", "key", F.col("rank").cast("long").alias("rank"), "score")
    out = E.floor_points(*_gold(spark, d), ranked, FLOORS)
    return out.select("floor", "n", "emptied", "tp", "fp_queries", "fn", *[F.round(c, 6).alias(c) for c in ("fp", "r10", "mrr", "exact_mrr", "precision", "recall", "f1")])


def hybrid_gold_outcomes(spark, d):
    """A gold run over whole searches: the ranks of their facts, whichever leg found them."""
    table, facts, vectors = G._query_table(spark, d), S.facts(spark, d), S.vectors(spark, d)
    hits = N.at_floors(table, facts, vectors, S.NOW, [0.1], _options())
    gold, expected = _gold(spark, d)
    out = E.outcomes(gold, expected, hits.select("query_id", F.col("id").alias("key"), "rank", "score"))
    return out.select("query_id", "class", "n_expected", *[F.round(c, 6).alias(c) for c in ("p5", "r10", "rr", "top_score")], "hit", "raw_hits")


def _fallen_back(spark, d):
    facts, files = S.facts(spark, d), G._parsed(spark, d)

    def store(queries):
        status = N.refused(queries, {"query too long": F.length("query") > MOST_CHARS})
        hits = N.lexical_search(queries.join(status.filter("error is null"), "query_id", "left_semi"), facts, S.NOW, 6)
        return hits.select("query_id", "id", "score", F.col("ord").alias("rank")), status

    def folder(queries):
        return topics.search(files, queries, 6), queries.select("query_id", F.lit(None).cast("string").alias("error"))

    return N.first_that_answers(S.text_queries(spark, d), {"store": store, "files": folder})


def lexical_fallback(spark, d):
    """Queries that are too long for the store's lexical leg are answered from the topic files."""
    return _fallen_back(spark, d)[0].select("query_id", "id", "rank", F.round("score", 6).alias("score"), "leg")


_ALL = (ann_topk_scoped, hybrid_floor_sweep, hybrid_gold_outcomes, lexical_fallback)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _judged(floor: float) -> str:
    """Gold queries, what they expect and the keys of a whole search at a floor, up to each query's outcome."""
    return f"""{G.hybrid_sql("score >= " + str(floor) if floor > 0 else "true")},
    gold AS (SELECT item_id AS query_id, text FROM benchmark), expected AS (SELECT query_id, id AS key FROM gold JOIN live ON scope IN ('en','fr','de','es') AND contains(data, text)),
    firsts AS (SELECT l.query_id, coalesce(target, l.nt) AS key, arg_min(l.id, o) AS lid FROM l LEFT JOIN alias a ON a.query_id = l.query_id AND a.nt = l.nt GROUP BY ALL),
    hits AS (SELECT query_id, CASE WHEN cosine_rank IS NOT NULL THEN key ELSE lid END AS key, rank, score FROM out LEFT JOIN firsts USING (query_id, key) WHERE rank <= 8),
    met AS (SELECT query_id, rank FROM hits SEMI JOIN expected USING (query_id, key)),
    outs AS (SELECT query_id, (SELECT count(*) FROM expected e WHERE e.query_id = gold.query_id) AS n_expected, (SELECT count(*) FROM met WHERE met.query_id = gold.query_id AND rank <= 5) AS near,
      (SELECT count(*) FROM met WHERE met.query_id = gold.query_id AND rank <= 10) AS far, coalesce((SELECT 1.0::DOUBLE / min(rank) FROM met WHERE met.query_id = gold.query_id), 0) AS rr,
      (SELECT count(*) FROM hits h WHERE h.query_id = gold.query_id) AS raw_hits, (SELECT max(score) FROM hits h WHERE h.query_id = gold.query_id) AS top_score FROM gold),
    classed AS (SELECT *, CASE WHEN n_expected > 0 THEN ['lexical-gap','exact-identifier'][CAST(query_id % 2 + 1 AS INT)] ELSE 'hard-negative' END AS class FROM outs)"""


def _point(floor: float) -> str:
    return f"""SELECT * FROM ({_judged(floor)}, counted AS (SELECT count(*) AS n, count(*) FILTER (n_expected > 0 AND raw_hits = 0) AS emptied, count(*) FILTER (n_expected > 0 AND near > 0) AS tp,
      count(*) FILTER (n_expected = 0 AND raw_hits > 0) AS fp_queries, count(*) FILTER (n_expected > 0 AND near = 0) AS fn, coalesce(avg((raw_hits > 0)::INT::DOUBLE) FILTER (n_expected = 0), 0) AS fp,
      coalesce(avg(far / n_expected::DOUBLE) FILTER (n_expected > 0), 0) AS r10, coalesce(avg(rr) FILTER (n_expected > 0), 0) AS mrr, coalesce(avg(rr) FILTER (class = 'exact-identifier'), 0) AS exact_mrr FROM classed),
      rates AS (SELECT *, CASE WHEN tp + fp_queries > 0 THEN tp / (tp + fp_queries)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS q FROM counted)
      SELECT CAST({floor} AS DOUBLE) AS floor, n, emptied, tp, fp_queries, fn, round(fp, 6) AS fp, round(r10, 6) AS r10, round(mrr, 6) AS mrr, round(exact_mrr, 6) AS exact_mrr,
        round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM rates)"""


def oracle_sql() -> dict[str, str]:
    topic, pairs = G.topic_sql()
    lex = C.lexical_sql()[2].replace("SELECT query_id, scope, id, data, raw / (3.0 * n) AS score FROM pairs", "SELECT query_id, scope, id, data, created_at, raw / (3.0 * n) AS score FROM pairs").replace("<= 18)", "<= 6)")
    files = pairs.replace("<= 10)", "<= 6)").replace("SELECT query_id, a.scope", "SELECT query_id, a.scope, len(tokens) AS n").replace("SELECT item_id AS query_id,", "SELECT item_id AS query_id, length(text) AS size,")
    return {
        "ann_topk_scoped": f"WITH {C.FACTS}, q AS (SELECT vec_id AS query_id, unnest(['en','fr','de','es']) AS scope FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, scope, least(8, count(*)) AS n, least(8, count(*)) AS ids FROM q JOIN live USING (scope) JOIN embeddings e ON e.vec_id = ord GROUP BY query_id, scope",
        "hybrid_floor_sweep": " UNION ALL ".join(map(_point, FLOORS)),
        "hybrid_gold_outcomes": f"{_judged(0.1)} SELECT query_id, class, n_expected, round(near / 5.0::DOUBLE, 6) AS p5, CASE WHEN n_expected > 0 THEN round(far / n_expected::DOUBLE, 6) END AS r10, round(rr, 6) AS rr, round(top_score, 6) AS top_score, near > 0 AS hit, raw_hits FROM classed",
        "lexical_fallback": f"""SELECT * FROM (WITH {C.FACTS}{lex}, best AS (SELECT query_id, id, max(score) AS score, any_value(created_at) AS created_at FROM lexleg GROUP BY query_id, id)
            SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank, round(CAST(score AS DOUBLE), 6) AS score, 'store' AS leg FROM best WHERE query_id IN (SELECT item_id FROM benchmark WHERE length(text) <= {MOST_CHARS}))
          UNION ALL SELECT * FROM ({topic}{files}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, created_at DESC, id) AS r FROM top),
            once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY place) = 1)
            SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, r) AS rank, round(CAST(score AS DOUBLE), 6) AS score, 'files' AS leg FROM once WHERE query_id IN (SELECT item_id FROM benchmark WHERE length(text) > {MOST_CHARS}))""",
    }
