"""Requests to remember something, as one plan: what is written to the log, with which vectors, and what each request is told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators import lifecycle as L
from factlake.operators.embedding import embed
from factlake.operators.extraction import ident


def _map(text: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def with_keys(metadata: Column, **values: Column) -> Column:
    """A JSON object with these keys over its own; null values leave a key as it is, and what is no object counts as an empty one."""
    new = _map(F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])))
    kept = F.map_filter(_map(metadata), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.to_variant_object(F.map_concat(kept, new)))


def events(requests: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """request, place, event, id, text of requests (request, scope, text, verbatim): a verbatim one is one ADD of its whole text, with an id
    of its own; the others give what `extract` makes of them (request, place, event, id, text)."""
    mine = F.coalesce("verbatim", F.lit(False))
    whole = requests.filter(mine & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("request", F.lit(0).alias("place"), F.lit("ADD").alias("event"), ident(F.col("request"), F.lit("verbatim"), F.col("text")).alias("id"), "text")
    return whole.unionByName(extract(requests.filter(~mine)).select("request", F.col("place").cast("int").alias("place"), F.upper("event").alias("event"), "id", "text"))


def plan(requests: DataFrame, extract: Callable[[DataFrame], DataFrame], by: Callable[[Column], Column], width: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """Changes of the log (n, op, id, payload, at, by, vector) and outcomes (request, ids, stored, failed) of requests, in one pass.

    requests: request, scope, text, kind, shareable, metadata (JSON), verbatim, embed_text. kind and shareable go over the metadata's own. Each distinct
    text is embedded once (`by`). Where a request has another text to embed, the facts that it adds get that text's vector, or their own text's if that
    fails or has another width. A fact without a vector of this width isn't written and counts as failed. ids: those added, which are UUIDs, in order;
    stored: facts added or updated.
    """
    met = events(requests, extract).join(requests.select("request", "scope", "kind", "shareable", "metadata", "embed_text"), "request")
    put = met.filter(F.col("event").isin("ADD", "UPDATE"))
    other = (F.col("event") == "ADD") & (F.coalesce("embed_text", F.lit("")) != "") & (F.col("embed_text") != F.col("text"))
    key = F.struct("request", "place")
    texts = put.select(F.struct(key.alias("k"), F.lit(0).alias("other")).alias("id"), "text").unionByName(put.filter(other).select(F.struct(key.alias("k"), F.lit(1).alias("other")).alias("id"), F.col("embed_text").alias("text")))
    good = embed(texts, by).filter(F.size("vector") == width).groupBy(F.col("id.k").alias("k")).agg(F.max_by("vector", "id.other").alias("vector"), F.min("id.other").alias("least"))
    made = put.withColumn("k", key).join(good.filter("least = 0").drop("least"), "k", "left").drop("k")
    payload = with_keys(F.col("metadata"), kind=F.col("kind"), shareable=F.col("shareable"), data=F.col("text"), user_id=F.col("scope"))
    columns = lambda op, body, vector: [F.col("place").cast("long").alias("n"), F.lit(op).alias("op"), "id", body.alias("payload"), at.alias("at"), F.lit(None).cast("string").alias("by"), vector.alias("vector")]
    writes = made.filter("vector is not null").select(*columns("upsert", payload, F.col("vector")))
    deletes = met.filter("event = 'DELETE'").select(*columns("delete", F.lit(None).cast("string"), F.lit(None).cast("array<double>")))
    told = made.select("request", "place", "event", "id", F.col("vector").isNotNull().alias("good"))
    counts = L.event_counts(told.filter("good").select("request", "id", "event", F.lit(None).cast("string").alias("nested")))
    added = F.sort_array(F.collect_list(F.when(F.col("good") & (F.col("event") == "ADD"), F.struct("place", "id"))))
    each = told.groupBy("request").agg(F.transform(added, lambda x: x["id"]).alias("ids"), F.count_if(~F.col("good")).alias("failed"))
    out = requests.select("request").join(each, "request", "left").join(counts.select("request", "stored"), "request", "left")
    return writes.unionByName(deletes), out.select("request", F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("ids"), F.coalesce("stored", F.lit(0)).cast("long").alias("stored"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))
