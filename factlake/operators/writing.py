"""The write path: vectors of facts, projections of facts in a second store, corpora seeded by keys, and what is read from JSON payloads."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.embedding import embed

# The widths of the embedders' vector tables.
WIDTHS = {"openai": 768, "local": 384, "gemma": 768, "harrier": 1024}


def active_space(mode: str | None, widths: dict[str, int] | None = None) -> tuple[str, int] | None:
    """The vector space that recall reads, and its width; None where embedding is off or the mode has none. widths: other spaces than WIDTHS."""
    known = WIDTHS if widths is None else widths
    return (mode, known[mode]) if mode in known else None


def temporal_controls(filters: dict | None) -> tuple[str | None, bool, dict]:
    """as_of (ISO; milliseconds since 1970 become UTC), include_superseded, and the other filters. An as_of that is no time is an error,
    as dropping it would answer for another time."""
    rest = dict(filters or {})
    at, wide = rest.pop("as_of", None), rest.pop("include_superseded", None)
    if at is not None:
        try:
            at = datetime.fromtimestamp(at / 1000, timezone.utc).isoformat() if isinstance(at, int | float) else datetime.fromisoformat(at).isoformat()
        except (TypeError, ValueError, OverflowError, OSError) as e:
            raise ValueError(f"as_of is no time: {at!r}") from e
    return at, wide in (True, "1", "true"), rest


def controls(filters: Column) -> Column:
    """temporal_controls() of a table's filters, each the JSON text of an object: a struct of as_of (null: now), include_superseded, rest (a JSON object of
    the other filters; null if there are none) and failed, which says that as_of is no time: such a request must not be answered for another time.

    Numbers are milliseconds since 1970. Null, and what is no JSON object, are filters without anything in them.
    """
    value = F.try_parse_json(filters)
    wide = _at(value, "include_superseded")
    kind, text = F.schema_of_variant(_at(value, "as_of")), _at(value, "as_of", "string")
    moment = F.when(kind == "STRING", F.try_to_timestamp(text)).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.timestamp_millis(text.try_cast("double").cast("long")))
    asked = F.coalesce(kind != "VOID", F.lit(False))
    yes = F.coalesce(F.schema_of_variant(wide).rlike("^(BOOLEAN|BIGINT|STRING|DOUBLE|DECIMAL)") & _at(value, "include_superseded", "string").isin("true", "1"), F.lit(False))
    rest = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin("as_of", "include_superseded"))
    return F.struct(moment.alias("as_of"), yes.alias("include_superseded"), F.when(F.size(rest) > 0, F.to_json(F.to_variant_object(rest))).alias("rest"), (asked & moment.isNull()).alias("failed"))


def upsert_vectors(vectors: DataFrame, made: DataFrame, facts: DataFrame, width: int) -> DataFrame:
    """vectors (fact_id, vector) with those of made in their places. Null vectors, those of another width and those of ids that facts don't have
    change nothing; the facts' texts stay as they are. Of several vectors for one fact, the one of the latest `at` counts if made has
    that column, else the greatest, so that the result doesn't depend on the rows' order."""
    good = made.filter(F.size("vector") == width).join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    latest = F.struct(*[c for c in ("at", "vector") if c in made.columns])
    good = good.groupBy("fact_id").agg(F.max_by("vector", latest).alias("vector"))
    return vectors.join(good.withColumnRenamed("vector", "new"), "fact_id", "full").select("fact_id", F.coalesce("new", "vector").alias("vector"))


def reembed(facts: DataFrame, source: DataFrame, target: DataFrame, by: Callable[[Column], Column], width: int) -> DataFrame:
    """target (fact_id, vector) with vectors of the facts (id, data) that source has and target lacks. Each distinct text is embedded once;
    empty texts, failures (null) and vectors of another width are left out, so a later pass tries them again. One table as source and target is an error."""
    if source is target:
        raise ValueError("source and target are the same vectors")
    rows = facts.select(F.col("id").alias("fact_id"), F.col("data").alias("text"))
    todo = rows.join(source.select("fact_id"), "fact_id", "left_semi").join(target.select("fact_id"), "fact_id", "left_anti")
    made = embed(todo.withColumnRenamed("fact_id", "id"), by).filter(F.size("vector") == width)
    return target.select("fact_id", "vector").unionByName(made.select(F.col("id").alias("fact_id"), "vector"))


def project(facts: DataFrame, id_: Column) -> DataFrame:
    """Copies of facts for a second store, under ids of its own; link_id names the fact that a copy is of."""
    return facts.withColumn("link_id", F.col("id")).withColumn("id", id_)


def forget_projections(projections: DataFrame, facts: DataFrame, gone: DataFrame) -> DataFrame:
    """projections without those that are linked with a fact among `gone` (id) and in its scope. A fact that goes and has no scope is an error:
    its copies couldn't be found, and would stay readable."""
    named = facts.join(gone.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("link_id"), "scope")
    # A job of its own, as an error inside the plan comes early, late or never, however the plan's filters are moved.
    lost = named.filter(F.coalesce("scope", F.lit("")) == "").first()
    if lost is not None:
        raise ValueError(f"no scope to find the copies of fact {lost.link_id}")
    return projections.join(named, ["link_id", "scope"], "left_anti")


def seed(corpus: DataFrame, scope: str) -> DataFrame:
    """The facts of a corpus (key, text, kind, description): id, data, kind, scope and metadata (JSON) with the key as corpus_key.

    Ids follow from scope, key and text, so a second seeding and a retried task write the same facts. Entries with a blank text
    have null ids: filter these for the facts; all rows are the manifest (see manifest())."""
    ident = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.md5(F.concat_ws("\n", F.lit(scope), "key", "text")))
    about = F.to_json(F.struct(F.when(F.col("description") != "", F.col("description")).alias("description"), F.col("key").alias("corpus_key")))
    return corpus.select(ident.alias("id"), F.col("text").alias("data"), "kind", F.lit(scope).alias("scope"), about.alias("metadata"), "key")


def manifest(seeded: DataFrame) -> DataFrame:
    """key, id and failed of each entry that was seeded: a row an entry, as a key may have many."""
    return seeded.select("key", "id", F.col("id").isNull().alias("failed"))


def unseed(facts: DataFrame, manifest_: DataFrame) -> DataFrame:
    """facts without those of a manifest."""
    return facts.join(manifest_.select("id"), "id", "left_anti")


def _at(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _told(value: object) -> str:
    """A value as JSON's text has it: whole numbers without a fraction."""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def having_payload(facts: DataFrame, payload: str = "payload", **wanted: object) -> DataFrame:
    """Rows whose JSON payload has these values, as text, at its keys (of which only letters, digits and _ count). None, truth values and
    containers are skipped; a key of which nothing counts is had by no row."""
    for name, value in wanted.items():
        if isinstance(value, str | int | float) and not isinstance(value, bool):
            key = re.sub("[^A-Za-z0-9_]", "", name)
            facts = facts.filter(_at(F.try_parse_json(payload), key, "string") == _told(value)) if key else facts.limit(0)
    return facts


def changed_at(payload: Column) -> Column:
    """The first of a payload's updated_at, updatedAt, created_at and createdAt that is a time: text, or milliseconds since 1970."""
    value = F.try_parse_json(payload)

    def moment(key: str) -> Column:
        kind, text = F.schema_of_variant(_at(value, key)), _at(value, key, "string")
        return F.when(kind == "STRING", F.try_to_timestamp(text)).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.timestamp_millis(text.try_cast("double").cast("long")))

    return F.coalesce(*map(moment, ("updated_at", "updatedAt", "created_at", "createdAt")))


def entries(rows: DataFrame) -> DataFrame:
    """id, text, kind, scope and metadata of rows (id, scope, payload): the text is the payload's `data` in text form, `kind` counts if it is
    a string, and metadata is a JSON object of all keys but data and user_id (null if there are no others)."""
    value = F.try_parse_json("payload")
    rest = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin("data", "user_id"))
    kind = F.when(F.schema_of_variant(_at(value, "kind")) == "STRING", _at(value, "kind", "string"))
    return rows.select("id", F.coalesce(_at(value, "data", "string"), F.lit("")).alias("text"), kind.alias("kind"), "scope", F.when(F.size(rest) > 0, F.to_json(F.to_variant_object(rest))).alias("metadata"))


def client_entries(rows: DataFrame) -> DataFrame:
    """id, text, kind, scope, score and metadata of a client's own rows (id, text, scope, score, metadata as JSON): a missing text is empty, `kind` of the
    metadata counts if it is a string, and metadata that are no JSON or null are none."""
    value = F.try_parse_json("metadata")
    there = F.schema_of_variant(value) != "VOID"
    kind = F.when(F.schema_of_variant(_at(value, "kind")) == "STRING", _at(value, "kind", "string"))
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"), "scope", F.col("score").cast("double").alias("score"), F.when(there, F.col("metadata")).alias("metadata"))


def ranked_keys(hits: DataFrame) -> DataFrame:
    """query_id, key, rank, score of hits (the same) by the first place of each key; hits without a key go, and ranks close up. Only a
    query's own hits meet in its window."""
    first = hits.filter("key is not null").groupBy("query_id", "key").agg(F.min("rank").alias("place"), F.min_by("score", "rank").alias("score"))
    return first.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "key")).alias("rank"), "score")
