"""Vectors of facts in several spaces: one table, a partition a space, of which recall reads the one that is chosen at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.writing import active_space
from factlake.sources.log import folders

SCHEMA = "fact_id string, vector array<double>, embedded_at timestamp"


def write(vectors: DataFrame, path: str, mode: str, widths: dict[str, int] | None = None) -> int:
    """Add vectors (fact_id, vector, embedded_at) to a space as a batch of its own, and return its number; one writer a space at a time.

    Vectors of another width than the space's and null ones are left out. Of several for one fact, the latest by embedded_at is read.
    """
    space = active_space(mode, widths)
    if space is None:
        raise ValueError(f"no such space: {mode}")
    rows = vectors.filter(F.size("vector") == space[1]).select("fact_id", F.col("vector").cast("array<double>").alias("vector"), "embedded_at")
    batch = 1 + max(folders(vectors.sparkSession, f"{path}/mode={mode}", "batch="), default=-1)
    rows.write.mode("overwrite").parquet(f"{path}/mode={mode}/batch={batch}")
    return batch


def scan(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """All batches of one space: other spaces' files aren't read."""
    return spark.read.schema(f"{SCHEMA}, mode string, batch int").parquet(path).filter(F.col("mode") == mode)


def read(spark: SparkSession, path: str, mode: str | None, widths: dict[str, int] | None = None) -> DataFrame:
    """fact_id, vector, embedded_at of the space that recall reads: each fact's latest. Without a space (embedding is off, or the mode has none) there is no row."""
    if active_space(mode, widths) is None:
        return spark.createDataFrame([], SCHEMA)
    last = F.max_by(F.struct("vector", "embedded_at"), F.struct("batch", "embedded_at"))
    return scan(spark, path, mode).groupBy("fact_id").agg(last.alias("last")).select("fact_id", "last.vector", "last.embedded_at")


def missing(spark: SparkSession, path: str, mode: str | None, facts: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """The facts (id) that have no vector in the space that recall reads; none where it reads none, as there is nothing to fill."""
    if active_space(mode, widths) is None:
        return facts.limit(0)
    return facts.join(scan(spark, path, mode).select(F.col("fact_id").alias("id")), "id", "left_anti")
