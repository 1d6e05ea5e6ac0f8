"""Embedding of texts: each distinct text once, a table of known vectors, and the widths that models declare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that reach an embedder.
MOST_CHARS = 32_000

# What the models' cards put before queries and documents.
TASK = "Given a web search query, retrieve relevant passages that answer the query"
PROMPTS = {
    ("gemma", "query"): "task: search result | query: ",
    ("gemma", "document"): "title: none | text: ",
    ("qwen3", "query"): f"Instruct: {TASK}\nQuery:",
    ("harrier", "query"): f"Instruct: {TASK}\nQuery: ",
}


def prompt(model: str, kind: str, text: Column) -> Column:
    """A text as a model wants it for its kind (query or document); as it is where the model asks for nothing."""
    return F.concat(F.lit(PROMPTS.get((model, kind), "")), text)


def hashed(text: Column, width: int) -> Column:
    """A deterministic unit vector of a text's tokens, for use where no model is at hand: the sum of hashed token vectors."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    unit = lambda t, i: F.xxhash64(t, i) / F.lit(2.0**63)
    total = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + unit(t, i)))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(total, lambda x: x / n)).otherwise(total)), F.lit(0))


def embed(texts: DataFrame, by: Callable[[Column], Column], known: DataFrame | None = None) -> DataFrame:
    """texts (id, text) with their vector: every distinct text goes to `by` (a Column function or a pandas UDF) once, and those in
    `known` (key: SHA-256 of the text, vector) not at all. Null and empty texts have no vector; a failure is a null, which is not kept."""
    rows = texts.withColumn("key", F.sha2(F.left("text", F.lit(MOST_CHARS)), 256))
    todo = rows.filter("text <> ''").select("key", F.left("text", F.lit(MOST_CHARS)).alias("text")).dropDuplicates(["key"])
    if known is not None:
        todo = todo.join(known.select("key"), "key", "left_anti")
    made = todo.select("key", by(F.col("text")).alias("vector"))
    if known is not None:
        made = made.unionByName(known.select("key", "vector"))
    return rows.join(made, "key", "left").select("id", "text", "vector")


def width_problems() -> Column:
    """What is wrong with a declaration (mode, native, mrl: none, discrete or continuous, trained, target, reason, tracked_by), as codes.

    A target that the model wasn't trained for needs a reason and where it is tracked; one that it was trained for must not have them.
    """
    native, target, trained = F.col("native"), F.col("target"), F.col("trained")
    fits = (target == native) | ((target > 0) & (target < native) & ((F.col("mrl") == "continuous") | ((F.col("mrl") == "discrete") & F.array_contains(trained, target))))
    excused = F.col("reason").isNotNull() | F.col("tracked_by").isNotNull()
    found = {
        "native not positive": native <= 0, "target not positive": target <= 0, "target over native": target > native, "native not trained": ~F.array_contains(trained, native),
        "several widths trained without mrl": (F.col("mrl") == "none") & (F.size(trained) != 1), "untrained target without reason": ~fits & ~excused, "stale reason": fits & excused,
        "empty reason": excused & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "empty tracked_by": excused & (F.trim(F.coalesce("tracked_by", F.lit(""))) == ""),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
