"""A fact table's change log as Parquet: one folder a batch, so that a batch written again replaces itself; reads fold the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.entities import low_quality
from factlake.operators import lifecycle as L

SCHEMA = "n long, op string, id string, payload string, at timestamp, by string, vector array<double>"
OPS = ("upsert", "patch", "embed", "invalidate", "delete")


def _junk() -> Column:
    """Whether a change writes a compound entity that is no noun phrase."""
    at = lambda k: F.try_variant_get(F.try_parse_json("payload"), f"$.{k}", "string")
    return (F.col("op") == "upsert") & F.coalesce(at("entityType") == "COMPOUND", F.lit(False)) & low_quality(at("data"))


def write_batch(changes: DataFrame, path: str, batch: int, width: int | None = None) -> None:
    """changes: n (order within the batch), op, id, payload, at, by and, if facts have vectors, vector. Keys named `validity` are computed on
    reading and never stored, and compound entities that are no noun phrases are left out.

    width: of the vectors. Every upsert then needs a payload and a vector of it, and every embed a vector; else the batch as a whole is refused
    (ValueError), and nothing of it is written.
    """
    vector = F.col("vector").cast("array<double>") if "vector" in changes.columns else F.lit(None).cast("array<double>").alias("vector")
    rows = changes.select("n", "op", "id", L.without_key(F.col("payload"), "validity").alias("payload"), "at", "by", vector.alias("vector")).filter(~F.coalesce(_junk(), F.lit(False)))
    if width is not None:
        # A job of its own, as an error inside the writing job could leave a part of the batch.
        wrong = F.col("vector").isNull() | (F.size("vector") != width) | ((F.col("op") == "upsert") & F.col("payload").isNull())
        bad = rows.filter(F.col("op").isin("upsert", "embed") & wrong).select("id", F.size("vector").alias("width"), F.col("payload").isNull().alias("bare")).first()
        if bad is not None:
            raise ValueError(f"change of {bad.id}: " + ("no payload" if bad.bare and bad.width == width else f"a vector of {max(bad.width or 0, 0)} numbers where {width} are expected"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders of a path that begin with a prefix."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return [int(s.getPath().getName()[len(prefix) :]) for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)]


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the last folder's; one writer at a time."""
    return 1 + max(folders(spark, path, "batch="), default=-1)


def append(changes: DataFrame, path: str, width: int | None = None) -> int:
    batch = next_batch(changes.sparkSession, path)
    write_batch(changes, path, batch, width)
    return batch


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log with its order as seq (a struct of batch and place)."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(path)
    return rows.withColumn("seq", F.struct("batch", "n")).drop("batch", "n")


def state(spark: SparkSession, path: str) -> DataFrame:
    return L.fold_patched(read(spark, path))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vector, embedded_at of the facts that the log leaves."""
    return L.fold_vectors(read(spark, path))


def history(spark: SparkSession, path: str) -> DataFrame:
    """lifecycle.history() of the log; seq is a number that grows with batch and place (a place is below 2^40)."""
    return L.history(read(spark, path).withColumn("seq", F.col("seq.batch") * (1 << 40) + F.col("seq.n")))


def forget_scope(spark: SparkSession, path: str, scope: str | None, at: Column) -> int:
    """Delete all facts whose payload's user_id is this scope, and their vectors: the number of the batch that says so."""
    facts = state(spark, path).select("id", F.get_json_object("payload", "$.user_id").alias("scope"))
    return append(L.forgotten_scope(facts, scope, at), path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the folded table as a new log of one batch of upserts, and the closes and vectors of its rows as the next one."""
    now = state(spark, path)
    put = now.select(F.lit(0).cast("long").alias("n"), F.lit("upsert").alias("op"), "id", "payload", F.col("created_at").alias("at"), F.lit(None).cast("string").alias("by"))
    shut = now.filter("invalid_at is not null").select(F.lit(0).cast("long").alias("n"), F.lit("invalidate").alias("op"), "id", F.lit(None).cast("string").alias("payload"), F.col("invalid_at").alias("at"), F.col("superseded_by").alias("by"))
    none = F.lit(None).cast("string")
    made = vectors(spark, path).select(F.lit(1).cast("long").alias("n"), F.lit("embed").alias("op"), "id", none.alias("payload"), F.col("embedded_at").alias("at"), none.alias("by"), "vector")
    write_batch(put, to, 0)
    write_batch(shut.withColumn("vector", F.lit(None).cast("array<double>")).unionByName(made), to, 1)
