"""The change log of a fact table and its fold, and maintenance passes over facts, vectors and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.ranking import previous


def fold(log: DataFrame) -> DataFrame:
    """id, payload, created_at, invalid_at, superseded_by of the rows that a change log leaves.

    log: seq, op (upsert, invalidate, delete), id, payload, at, by. The last upsert's payload wins, while the times of the first one
    and of the first close stay: a closed row that is written again stays closed. Nothing before a row's last delete counts, nor a
    close before its first upsert. Only aggregates that combine on the map side, so an id with many changes is no single task's work.
    """
    gone = log.filter("op = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    since = log.filter("op <> 'delete'").join(gone, "id", "left").filter("gone is null or seq > gone").drop("gone")
    begun = since.filter("op = 'upsert'").groupBy("id").agg(F.min_by("at", "seq").alias("created_at"), F.max_by("payload", "seq").alias("payload"), F.min("seq").alias("begun"))
    closes = since.filter("op = 'invalidate'").join(begun.select("id", "begun"), "id").filter("seq > begun")
    closed = closes.groupBy("id").agg(F.min_by("at", "seq").alias("invalid_at"), F.min_by("by", "seq").alias("superseded_by"))
    return begun.join(closed, "id", "left").select("id", "payload", "created_at", "invalid_at", "superseded_by")


def fold_vectors(log: DataFrame) -> DataFrame:
    """id, vector, embedded_at that a log's changes leave: the last vector of an upsert or an embed (a vector alone) counts. A delete takes
    the vector with the fact, and an embed of a fact that isn't there has no effect."""
    gone = log.filter("op = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    since = log.filter("op in ('upsert', 'embed')").join(gone, "id", "left").filter("gone is null or seq > gone").drop("gone")
    begun = since.filter("op = 'upsert'").groupBy("id").agg(F.min("seq").alias("begun"))
    last = since.filter("vector is not null").join(begun, "id").filter("seq >= begun").groupBy("id").agg(F.max_by(F.struct("vector", "at"), "seq").alias("last"))
    return last.select("id", "last.vector", F.col("last.at").alias("embedded_at"))


def history(log: DataFrame) -> DataFrame:
    """id, seq, event (ADD, UPDATE, DELETE), old, new, at of a log's upserts, patches and deletes (seq: a number).

    `old` is the payload of the last upsert since the last delete, `new` what the change brings: only its keys if it is a patch. What changes a row that
    isn't there, other than an upsert, is no event.
    """
    rows = log.filter("op in ('upsert', 'patch', 'delete')").select("id", "seq", "op", "payload", "at")
    whole = F.when(F.col("op") != "patch", F.struct("op", "payload"))
    seen = previous(rows, ["id"], "seq", whole, "before")
    there = F.coalesce(F.col("before.op") == "upsert", F.lit(False))
    event = F.when(~there & (F.col("op") == "upsert"), "ADD").when(there & (F.col("op") == "delete"), "DELETE").when(there, "UPDATE")
    told = seen.select("id", "seq", event.alias("event"), F.when(there, F.col("before.payload")).alias("old"), F.when(F.col("op") != "delete", F.col("payload")).alias("new"), "at")
    return told.filter("event is not null")


def forgotten_scope(facts: DataFrame, scope: str | None, at: Column) -> DataFrame:
    """Changes that delete all facts (id, scope) of a scope, their vectors with them once the log is folded. Without a scope this is an error, as it would
    delete everybody's facts."""
    if not scope:
        raise ValueError("no scope to forget")
    none = F.lit(None).cast("string")
    return facts.filter(F.col("scope") == scope).select(F.lit(0).cast("long").alias("n"), F.lit("delete").alias("op"), "id", none.alias("payload"), at.alias("at"), none.alias("by"))


def without_key(payload: Column, key: str) -> Column:
    """A JSON object without one of its keys; any other text, and objects that don't have the key, as they are."""
    value = F.try_parse_json(payload)
    has = F.array_contains(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), key)
    left = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: k != key)
    return F.when(has, F.to_json(F.to_variant_object(left))).otherwise(payload)


def merged(changes: DataFrame) -> DataFrame:
    """id, payload: the JSON objects of changes (id, seq, op, payload) put together key by key from each id's last upsert on, the latest
    value of a key winning, nested ones whole and explicit nulls too. An id that only has patches has no row."""
    base = changes.filter("op = 'upsert'").groupBy("id").agg(F.max("seq").alias("base"))
    since = changes.filter("op in ('upsert', 'patch')").join(base, "id").filter("seq >= base")
    keys = since.select("id", "seq", F.explode_outer(F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")).alias("key", "value"))
    # A pair is carried as its JSON text, so that it combines on the map side.
    pair = keys.withColumn("pair", F.when(F.col("key").isNotNull(), F.to_json(F.to_variant_object(F.create_map("key", "value")))))
    last = pair.groupBy("id", "key").agg(F.max_by("pair", "seq").alias("pair"))
    inner = F.transform(F.array_sort(F.collect_list("pair")), lambda p: F.substring(p, F.lit(2), F.length(p) - 2))
    return last.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("payload"))


def fold_patched(log: DataFrame) -> DataFrame:
    """fold() of a log that has patches besides: their keys replace those of the payload before them. Payloads without patches stay as
    they were written; patches of rows that aren't there have no effect."""
    folded = fold(log.filter("op <> 'patch'"))
    touched = log.filter("op = 'patch'").select("id").distinct()
    some = log.join(touched, "id", "left_semi")
    gone = some.filter("op = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    rest = some.filter("op <> 'delete'").join(gone, "id", "left").filter("gone is null or seq > gone").drop("gone")
    return folded.join(merged(rest).withColumnRenamed("payload", "patched"), "id", "left").withColumn("payload", F.coalesce("patched", "payload")).drop("patched")


def cascade(vectors: DataFrame, log: DataFrame) -> DataFrame:
    """Vectors (id, ...) of ids that the log has not deleted since they were last written."""
    last = log.filter("op in ('upsert', 'delete')").groupBy("id").agg(F.max_by("op", "seq").alias("op"))
    return vectors.join(last.filter("op = 'delete'"), "id", "left_anti")


def validity(facts: DataFrame, at: Column, asked: bool = False) -> DataFrame:
    """facts with a struct of their validity times and status at a time; null where no time is set, unless a time was asked for."""
    status = F.when(F.col("invalid_at") <= at, "superseded").otherwise("current")
    some = F.coalesce("valid_at", "invalid_at").isNotNull() | F.col("superseded_by").isNotNull() | F.lit(asked)
    return facts.withColumn("validity", F.when(some, F.struct("valid_at", "invalid_at", "superseded_by", status.alias("status"))))


def having(facts: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have these values as text. None, truth values and containers are skipped, as the store does."""
    for name, value in wanted.items():
        if isinstance(value, str | int | float) and not isinstance(value, bool):
            facts = facts.filter(F.col(name).cast("string") == str(value))
    return facts


def first_rows(rows: DataFrame, by: str, order: list[Column], most: int, parts: int = 64) -> DataFrame:
    """Each group's first `most` rows. Those of parts of a group are taken first, so that no task sorts a whole one, however large `most` is."""
    from pyspark.sql.window import Window

    top = lambda df, *keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("r") <= most).drop("r")
    return top(top(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), by, "part").drop("part"), by)


def capped(facts: DataFrame, cap: int, kind: str | None = None) -> DataFrame:
    """Each scope's newest `cap` rows; the kind is filtered after that, so fewer may be left."""
    out = first_rows(facts, "scope", [F.desc("created_at"), F.col("id")], cap)
    return out if kind is None else out.filter(F.col("kind") == kind)


def reembed_outcomes(facts: DataFrame, source: DataFrame, target: DataFrame, width: int) -> DataFrame:
    """outcome and n of a pass that fills the target vectors from facts that have source vectors: text that is empty is skipped,
    an embedding (column `made`, null where it failed) of another width is an error."""
    todo = facts.join(source.select("id"), "id", "left_semi").join(target.select("id"), "id", "left_anti")
    outcome = F.when(F.coalesce("data", F.lit("")) == "", "skipped").when(F.coalesce(F.size("made"), F.lit(-1)) != width, "error").otherwise("reembedded")
    return todo.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def relink(entities: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """From entities (id, junk, links): the first `limit` facts that junk entities link to, and the junk entities that link to
    nothing else (those without links stay)."""
    edges = entities.filter("junk").select("id", F.explode("links").alias("fact"))
    affected = edges.select("fact").distinct().orderBy("fact").limit(limit)
    known = edges.join(affected.withColumn("inside", F.lit(True)), "fact", "left")
    return affected, known.groupBy("id").agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("all_inside")).filter("all_inside").select("id")


def truncate_vector(vector: Column, width: int) -> Column:
    """The first `width` components, of length 1 again; zero vectors stay."""
    head = F.slice(vector, 1, width)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(head, lambda x: x / n)).otherwise(head)), F.lit(0))


def event_counts(results: DataFrame) -> DataFrame:
    """request, added, stored of the rows (request, id, event, nested) that writing gave back: added are rows of event ADD with
    a UUID as id, stored those of ADD or UPDATE. An event at the top goes before a nested one; case doesn't matter."""
    event = F.upper(F.coalesce("event", "nested", F.lit("")))
    uuid = F.coalesce(F.lower("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))
    return results.groupBy("request").agg(F.count_if((event == "ADD") & uuid).alias("added"), F.count_if(event.isin("ADD", "UPDATE")).alias("stored"))
