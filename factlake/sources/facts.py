"""The fact table, its vectors and the query table, as views over the driver's tables (integer arithmetic only, so SQL can repeat it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for every query, so that results do not depend on the clock.
NOW = "2024-03-01 00:00:00"


#: The scopes that facts have, all of which queries ask.
SCOPES = ["en", "fr", "de", "es"]


def _scopes():
    return F.array(*map(F.lit, SCOPES))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hours = lambda n: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {n})")
    return d.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("data"), F.col("source").alias("name"),
        F.col("lang").alias("scope"), F.expr("element_at(array('project', 'feedback', 'reference', 'user'), cast(doc_id % 4 + 1 as int))").alias("kind"),
        hours("cast(doc_id as int)").alias("created_at"), F.when(F.col("doc_id") % 3 == 0, hours("cast(doc_id + doc_id % 29 * 24 as int)")).alias("updated_at"),
        F.when(F.col("doc_id") % 5 == 0, hours("cast(doc_id as int) - 24")).alias("valid_at"),
        F.when(F.col("doc_id") % 7 == 0, hours("cast(doc_id as int) + 720")).alias("invalid_at"), F.when(F.col("doc_id") % 7 == 0, (F.col("doc_id") + 1).cast("string")).alias("superseded_by"),
        F.when(F.col("doc_id") % 13 == 0, "archived").otherwise("active").alias("state"), F.when(F.col("doc_id") % 11 == 0, "COMPOUND").alias("entity_type"),
    )


def linked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, every third of them a projection of another one that link_id names."""
    return facts(spark, sf_dir).withColumn("link_id", F.when(F.col("ord") % 3 == 0, (F.col("ord") + 3 - F.col("ord") % 6 * 2).cast("string")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("fact_id"), F.col("embedding").cast("array<double>").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every hundredth vector, asked in all scopes."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"), _scopes().alias("scopes"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), _scopes().alias("scopes"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of changes of their users' rows: errors close them, purchases delete them, all others write them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "invalidate").when(F.col("event_type") == "purchase", "delete").otherwise("upsert")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("payload"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("by"))
