"""A training corpus from raw documents, in five stages: quality rules, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import ngram_join, packing, quality, secret_scan, substring_dedup
from factlake.llm.common import Workspace
from factlake.llm.queries import tokenizer_path


def _counted(changed: Column, docs: DataFrame) -> list[Column]:
    """The columns of documents; n_chars, if there is one, is the text's length where the text has changed."""
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return [length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]


# Every stage needs doc_id and text. Further columns come through as they are, whatever their names; an empty table stays empty.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with a null or empty text among them. Repeated rows stay or go together."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id. Null and empty texts are like no other, so they stay, as do
    rows with a null doc_id and repeats of a row that stays."""
    return ngram_join.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; n_chars follows. Texts that lose nothing stay as they are, null and empty
    ones and those of a null doc_id among them, and texts that lose all their words are gone with them. Repeated rows take nothing from each other."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]  # the text is shuffled once
    cut = substring_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(*rest).alias("row")))
    left = cut.filter("n_removed = 0 or n_removed < n_words").select("row.*", "text", F.when(F.col("n_removed") > 0, F.col("kept_text")).alias(_free(docs)))
    changed = F.col(_free(docs)).isNotNull()
    return left.withColumn("text", F.coalesce(_free(docs), "text")).select(_counted(changed, docs))


def _free(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return next(f"kept{i}" for i in range(len(docs.columns) + 1) if f"kept{i}" not in docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows. Null and empty texts stay as they are; repeated rows are masked alike."""
    before = _free(docs)
    masked = secret_scan.redact(docs.withColumn(before, F.xxhash64("text")))
    return masked.select(_counted(F.col(before) != F.xxhash64("text"), docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids. A null or empty text is its end token alone; repeated rows are packed each for itself; an empty table
    has no sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("secrets", secrets), ("packing", pack_sequences)]
#: Neither set similarity over all pairs, nor hashes of windows, nor tokens can be had from SQL over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents. Each stage's rows are written to the shared folder and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir))
        work.finish(docs)  # the stage before isn't read any more
    return docs
