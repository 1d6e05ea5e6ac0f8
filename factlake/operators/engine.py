"""Searches as one plan for a whole query table: options, the two legs, their fusion, and counts of what each leg did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators import rerank
from factlake.operators import retrieval as R


@dataclass(frozen=True)
class SearchOptions:
    """limit: hits a query (None: all of both legs). A floor needs a fusion mode, as the two modes treat it differently. as_of goes before include_superseded."""

    limit: int | None = 6
    depth: int | None = None
    fusion_mode: str | None = None
    least_score: float | None = None
    least_ratio: float | None = None
    least_lexical: float = 0.3
    lexical_weight: float = 1.0
    as_of: str | None = None
    include_superseded: bool = False
    forward_temporal: bool = False
    diversity: float = 1.0

    def __post_init__(self):
        if (self.least_score is not None or self.least_ratio is not None) and self.fusion_mode is None:
            raise ValueError("a floor needs a fusion mode")
        if self.fusion_mode not in (None, "floored-union", "cosine-gated"):
            raise ValueError(f"no such fusion mode: {self.fusion_mode}")
        if self.as_of is not None:
            datetime.fromisoformat(self.as_of)

    def validity(self, now: str) -> Column | None:
        if self.as_of is not None:
            return R.as_of(self.as_of)
        return None if self.include_superseded else R.current(now)


def last_change(rows: DataFrame) -> Column:
    """When facts last changed: updated_at, or created_at where there is none."""
    return F.coalesce(*[c for c in ("updated_at", "created_at") if c in rows.columns])


def search(queries: DataFrame, facts: DataFrame, vectors: DataFrame, now: str, options: SearchOptions = SearchOptions(), texts: bool = True) -> DataFrame:
    """query_id, id, ord (place by score times recency), data, score: the nearest facts of all scopes of a query (query_id, vector, scopes).
    Without texts there is scope, and no data.

    The floor's ratio is to the query's best score over all scopes, and the score returned isn't weighted by recency, which goes by
    updated_at where the facts have one, else by created_at.
    """
    pulled = R.vector_leg(queries, R.readable(facts, options.validity(now)), vectors, options.limit or 8, texts)
    kept = R.floor(R.merge_scopes(pulled), options.least_score, options.least_ratio)
    weighted = kept.withColumn("w", F.round(F.col("score") * R.recency(last_change(kept), now), 12))
    out = R.ranked(weighted.drop("ord"), [F.desc_nulls_last("w"), F.col("id")], "ord").select("query_id", "id", "ord", "data" if texts else "scope", "score")
    if options.diversity >= 1:
        return out
    shape = out.select("query_id", F.col("id").alias("key"), "data", "score", F.col("ord").alias("rank"))
    return rerank.diverse(shape, options.diversity).select("query_id", F.col("key").alias("id"), F.col("rank").alias("ord"), "data", "score")


def lexical_search(queries: DataFrame, facts: DataFrame, now: str, limit: int = 18, validity: Column | None = None, texts: bool = True) -> DataFrame:
    """The same by tokens of query, without floor and recency; link_id, too, if the facts have it."""
    hits = R.merge_scopes(R.lexical_leg(queries, R.readable(facts, R.current(now) if validity is None else validity), limit, texts))
    return R.ranked(hits.drop("ord"), [F.desc("score"), F.desc("created_at"), F.col("id")], "ord").select("query_id", "id", "ord", "data" if texts else "scope", "score", *[c for c in facts.columns if c == "link_id"])


def hybrid(queries: DataFrame, facts: DataFrame, vectors: DataFrame, now: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Fused hits (see retrieval.fuse) of queries (query_id, query, lexical_query, vector, scopes), at most `limit` each.

    A fact's link_id, if there is one, names the fact that it is a projection of: both are one hit. The lexical leg asks for lexical_query where that isn't blank; unless forward_temporal is set it sees the current facts, whatever
    time the options name. Diversity re-ranks the first three times `limit` hits; the rest follows in order.
    """
    (cos, near), (lex, worded) = _legs(queries, facts, vectors, now, options, raw=options.diversity < 1)
    fused = R.fuse(cos, lex, least_lexical=options.least_lexical, weight=options.lexical_weight, gated=options.fusion_mode == "cosine-gated", texts=near.unionByName(worded))
    if options.diversity < 1:
        head = 3 * options.limit if options.limit else None
        with_data = lambda leg, own, key: leg.join(own.select("scope", "id", "data"), ["scope", "id"]).select("query_id", key.alias("key"), "data")
        texts = with_data(cos, near, F.col("id")).unionByName(with_data(lex, worded, F.coalesce("link_id", "id"))).groupBy("query_id", "key").agg(F.min("data").alias("data"))
        rows = fused.join(texts, ["query_id", "key"], "left")
        first = rows if head is None else rows.filter(F.col("rank") <= head)
        fused = rerank.diverse(first, options.diversity).select(fused.columns)
        if head is not None:
            fused = fused.unionByName(rows.filter(F.col("rank") > head).select(fused.columns))
    return fused if options.limit is None else fused.filter(F.col("rank") <= options.limit)


def hit_ids(fused: DataFrame, lex: DataFrame) -> DataFrame:
    """fused hits of named legs (see retrieval.fuse_names) with lexical_id, the lexical leg's first fact of that key."""
    key = F.coalesce(F.when(F.col("link_id") != "", R.name_of(F.col("link_id"))), F.col("name"))
    first = lex.select("query_id", key.alias("key"), "id", "ord").groupBy("query_id", "key").agg(F.min_by("id", "ord").alias("lexical_id"))
    return fused.join(first, ["query_id", "key"], "left")


def at_floors(queries: DataFrame, facts: DataFrame, vectors: DataFrame, now: str, floors: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
    """query_id, floor, id and the columns of hybrid(): its hits at each of the floors, from one evaluation of both legs.

    A floor cuts the cosine leg before recency, ranks and fusion, so each hit is taken to all floors that it reaches and ranked among
    those that do; the lexical leg is the same at all. A floor of 0 or less cuts nothing. least_ratio, if set, holds at all floors.
    """
    if options.diversity < 1:
        raise ValueError("floors are swept without diversity")
    none = F.lit(None).cast("string")
    readable = R.readable(facts, options.validity(now))
    pulled = R.vector_leg(queries.filter("vector is not null"), readable, vectors, options.limit or 8, texts=False)
    over = R.floor(R.merge_scopes(pulled), None, options.least_ratio)
    weighted = over.withColumn("w", F.round(F.col("score") * R.recency(last_change(over), now), 12)).drop("ord")
    reached = F.filter(F.array(*map(F.lit, floors)), lambda f: (f <= 0) | F.col("score").isNull() | (F.col("score") >= f))
    each = lambda df, f: df.withColumn("floor", F.explode(f)).withColumn("query_id", F.struct("query_id", "floor")).drop("floor")
    cos = R.ranked(each(weighted, reached), [F.desc_nulls_last("w"), F.col("id")], "ord").select("query_id", "scope", "id", "ord", "score").withColumn("link_id", none)
    cos, near = R.named(cos, readable)
    lex, worded = R.named(*_lexical(queries, facts, now, options))
    lex = each(lex, F.array(*map(F.lit, floors)))
    fused = hit_ids(R.fuse_names(cos, lex, least_lexical=options.least_lexical, weight=options.lexical_weight, gated=options.fusion_mode == "cosine-gated"), lex)
    out = fused if options.limit is None else fused.filter(F.col("rank") <= options.limit)
    out = R.with_keys(out, cos, lex, near.unionByName(worded)).withColumn("id", F.when(F.col("cosine_rank").isNotNull(), F.col("key")).otherwise(F.col("lexical_id"))).drop("lexical_id")
    return out.select("query_id.query_id", "query_id.floor", *[c for c in out.columns if c != "query_id"])


def refused(queries: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """query_id, error: the first rule (its name) that holds for a query, null for queries that may run. A leg's failures are rows, so that they are told by query."""
    return queries.select("query_id", F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules.items()], F.lit(None).cast("string")).alias("error"))


def first_that_answers(queries: DataFrame, legs: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank, leg) and (query_id, error): each query by the first leg that doesn't fail for it.

    A leg makes of queries their hits (query_id, id, score, rank) and a status (query_id, error), in which null means an answer, if an empty one, and
    a query without a row has failed. Only failed queries go to the next leg; those that all legs fail keep the last one's error.
    """
    hits, status, left = None, None, queries
    for name, leg in legs.items():
        found, told = leg(left)
        told = left.select("query_id").join(told.withColumn("told", F.lit(True)), "query_id", "left").select("query_id", F.when(F.col("told").isNull(), F.lit("no answer")).otherwise(F.col("error")).alias("error"))
        done = told.filter("error is null")
        mine = found.join(done.select("query_id"), "query_id", "left_semi").select("query_id", "id", "score", "rank", F.lit(name).alias("leg"))
        hits, status = (mine, done) if hits is None else (hits.unionByName(mine), status.unionByName(done))
        failed = told.filter("error is not null")
        left = left.join(failed.select("query_id"), "query_id", "left_semi")
    return hits, status.unionByName(failed)


def leg_stats(queries: DataFrame, facts: DataFrame, vectors: DataFrame, now: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """query_id, cosine and lexical candidates, lexical ones that reach the bar, and fused hits before the limit."""
    (cos, _), (lex, _) = _legs(queries, facts, vectors, now, options)
    fused = R.fuse_names(cos, lex, least_lexical=options.least_lexical, weight=options.lexical_weight, gated=options.fusion_mode == "cosine-gated")
    count = lambda df, name, cond="true": df.groupBy("query_id").agg(F.count_if(F.expr(cond)).alias(name))
    out = queries.select("query_id").join(count(cos, "cosine"), "query_id", "left").join(count(lex, "lexical"), "query_id", "left")
    out = out.join(count(lex, "qualifying", f"score is null or score >= {options.least_lexical}"), "query_id", "left").join(count(fused, "fused"), "query_id", "left")
    return out.fillna(0)


def _legs(queries, facts, vectors, now, options, raw=False):
    """Each leg with names for texts, and its texts (see retrieval.named)."""
    none = F.lit(None).cast("string")
    cosine_options = replace(options, diversity=1.0)
    cos = search(queries.filter("vector is not null"), facts, vectors, now, cosine_options, texts=False).withColumn("link_id", none)
    return R.named(cos, R.readable(facts, options.validity(now)), raw), R.named(*_lexical(queries, facts, now, options), raw)


def _lexical(queries, facts, now, options):
    """The lexical leg without texts, and the facts that it sees."""
    words = queries.withColumn("query", F.when(F.trim("lexical_query") != "", F.col("lexical_query")).otherwise(F.col("query")))
    when = options.validity(now) if options.forward_temporal else None
    if options.forward_temporal and when is None:
        when = F.lit(True)
    linked = facts if "link_id" in facts.columns else facts.withColumn("link_id", F.lit(None).cast("string"))
    return lexical_search(words, linked, now, options.depth or 3 * (options.limit or 6), when, texts=False), R.readable(linked, R.current(now) if when is None else when)
