"""Facts extracted from windows of conversations: any extractor as a generator, failures as rows, and changes of the log that a repeated task writes alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task holds before it sends them.
HELD = 1 << 12


def windows(messages: DataFrame, size: int = 10) -> DataFrame:
    """conv_id, window, n, text of messages (conv_id, turn, role, text): `size` turns each, a line `role: text` a turn, in order. Null texts are left out of their lines."""
    w = messages.withColumn("window", F.floor(F.col("turn") / size))
    lines = w.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("lines"))
    return lines.select("conv_id", "window", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def extract(rows: DataFrame, by: Callable[[str], Iterable[str]], keys: list[str], text: str = "text") -> DataFrame:
    """keys, place, fact, error: what `by` makes of each row's text, none, one or many facts in their order.

    A row for which it fails gives one row with the error and no fact, whatever it had made by then, and stops no other. Null and empty texts have no
    facts. `by` runs in the tasks, so it must not depend on their order or number.
    """
    schema = rows.select(*keys).schema.add("place", T.IntegerType()).add("fact", T.StringType()).add("error", T.StringType())

    def batch(source: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        at, place, fact, error = zip(*held)
        index = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*(c.take(index) for c in source.columns[:-1]), pa.array(place, pa.int32()), pa.array(fact, pa.string()), pa.array(error, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not t:
                    continue
                try:
                    held += [(i, n, f, None) for n, f in enumerate(by(t))]
                except Exception as e:  # noqa: BLE001 - a failure is a row
                    held.append((i, None, None, f"{type(e).__name__}: {e}"))
                if len(held) >= HELD:
                    yield batch(b, held)
                    held = []
            if held:
                yield batch(b, held)

    return rows.select(*keys, text).mapInArrow(run, schema)


def ident(*parts: Column) -> Column:
    """A UUID of some columns, the same for each run."""
    return F.regexp_replace(F.md5(F.concat_ws("\n", *[p.cast("string") for p in parts])), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def changes(extracted: DataFrame, keys: list[str], scope: Column, at: Column) -> DataFrame:
    """n, op, id, payload, at, by: extracted facts as upserts of the log. Ids follow from the keys, the place and the fact, so a window that is extracted
    again, or a task that runs again, writes the same facts. The payload says where a fact comes from."""
    origin = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    payload = F.to_json(F.struct(F.col("fact").alias("data"), scope.alias("user_id"), origin.alias("origin")))
    good = extracted.filter("error is null")
    return good.select(F.col("place").cast("long").alias("n"), F.lit("upsert").alias("op"), ident(*[F.col(k) for k in keys], F.col("place"), F.col("fact")).alias("id"), payload.alias("payload"), at.alias("at"), F.lit(None).cast("string").alias("by"))


def again(facts: DataFrame, affected: DataFrame, rows: DataFrame, by: Callable[[str], Iterable[str]], keys: list[str], scope: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Changes that extract anew what `affected` facts (id) come from, and the failures (keys, error).

    facts: id, payload with an origin, as changes() made them. Each origin of an affected fact is extracted once; its facts that are made no more are deleted
    (those that are made again are written again), and an origin that fails keeps what it has.
    """
    where = lambda df: df.withColumn("origin", F.get_json_object("payload", "$.origin"))
    mine = where(facts.join(affected.select("id").distinct(), "id", "left_semi")).select("origin").distinct()
    origin = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    made = extract(rows.withColumn("origin", origin).join(mine, "origin", "left_semi"), by, [*keys, "origin"])
    failed = made.filter("error is not null")
    put = changes(made, keys, scope, at)
    redone = mine.join(failed.select("origin"), "origin", "left_anti")
    old = where(facts).join(redone, "origin", "left_semi").select("id").join(put.select("id"), "id", "left_anti")
    gone = old.select(F.lit(-1).cast("long").alias("n"), F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("payload"), at.alias("at"), F.lit(None).cast("string").alias("by"))
    return put.unionByName(gone), failed.select(*keys, "error")
