"""A folder of topic files as a table: reading, adding, changing, archiving and searching it."""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.functions import text as T
from factlake.functions import topics as P
from factlake.operators import index as X
from factlake.operators.ranking import numbered, running
from factlake.sources.folders import kept, local_folder

#: Names, and bytes of files, that a task sends at once.
NAMES, SENT_BYTES = 1 << 14, 4 << 20


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, id, modified and the parsed fields of every topic file right in a folder; index files and sub-folders are left out.

    The files are those there at the call. A local or mounted folder is listed and read in the tasks; others (and patterns) by Spark's reader, whose driver holds
    an entry a file. Joins go by sorting, as the size of what is read isn't known beforehand.
    """
    at = local_folder(spark, path)
    if at is None:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
        raw = raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("modified"), "content")
    else:
        raw = _contents(_names(spark, at), at)
    rows = raw.select("file", "modified", P.parse(F.col("content").cast("string")).alias("t"))
    return rows.filter(~F.col("file").isin(P.INDEX_FILES)).select("file", F.regexp_replace("file", "\\.md$", "").alias("id"), "modified", "t.*").hint("merge")


def _names(spark: SparkSession, at: str) -> DataFrame:
    """name of each topic file right in a local folder, kept as a table. Each task goes through the folder and keeps its share, so nothing holds all names.
    As Spark's reader does, it leaves out hidden files (those that begin with a dot or an underscore)."""
    shares = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in (i for batch in batches for i in batch.column(0).to_pylist()):
            with os.scandir(os.fsencode(at)) as found:
                mine = (e.name for e in found if e.name.endswith(b".md") and e.name[:1] not in (b".", b"_") and zlib.crc32(e.name) % shares == share and e.is_file())
                while some := list(islice(mine, NAMES)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["name"])

    return kept(spark.range(0, shares, 1, shares).mapInArrow(run, "name binary"), "topic-names")


def _contents(names: DataFrame, at: str) -> DataFrame:
    """file, modified, content of the files of a local folder that are named."""

    def batch(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["name", "ms", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named in batches:
            held, size = [], 0
            for name in named.column(0).to_pylist():
                with open(os.path.join(os.fsencode(at), name), "rb") as file:
                    held.append((name, os.fstat(file.fileno()).st_mtime_ns // 1_000_000, file.read()))
                size += len(held[-1][2])
                if size >= SENT_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    rows = names.mapInArrow(run, "name binary, ms long, content binary")
    return rows.select(F.col("name").cast("string").alias("file"), F.timestamp_millis("ms").alias("modified"), "content")


def new_topics(facts: DataFrame, taken: DataFrame) -> DataFrame:
    """id, content of topic files for facts (ord, text, kind, scope, description, extra), beside the ids of `taken`.

    The n-th fact of a base name gets its n-th free form: base, base_2, base_3, ... A fact's own base goes before another's form that
    looks alike. Numbers are running sums over parts of a base (see operators.ranking), so no task has a whole base and no set of names is gathered.
    """
    said = F.when(P.strip(F.col("description")) != "", F.col("description")).otherwise(F.col("text"))
    rows = facts.withColumn("description", P.describe(said)).withColumn("base", P.base_id(F.col("kind"), F.col("description")))
    rows = numbered(rows.withColumn("ord", F.col("ord").cast("long")), ["base"], "ord", "n")
    names = taken.select(F.col("id")).unionByName(rows.select(F.col("base").alias("id"))).distinct()
    # As another's numbered form every name counts as used; as a base itself only the names there already.
    forms = names.select(F.regexp_extract("id", "^(.*)_([2-9]|[1-9][0-9]{1,8})$", 1).alias("base"), F.regexp_extract("id", "_([0-9]{1,9})$", 1).alias("i")).filter("base <> ''")
    used = forms.select("base", F.col("i").cast("int").alias("i")).unionByName(taken.select(F.col("id").alias("base"), F.lit(1).alias("i"))).distinct().join(rows.select("base").distinct(), "base", "left_semi")
    # The n-th free number is n plus the used numbers t_j, the j-th of all, with t_j - j < n.
    used = numbered(used, ["base"], "i", "j").withColumn("at", F.col("i") - F.col("j"))
    slots = used.select("base", "at", F.lit(None).cast("long").alias("ord"), F.lit(1).alias("is_used")).unionByName(rows.select("base", (F.col("n") - 1).alias("at"), F.col("ord").cast("long"), F.lit(0).alias("is_used")))
    number = running(slots, ["base"], "at", F.col("is_used"), "before", [F.desc("is_used")]).filter("is_used = 0").select("ord", (F.col("at") + 1 + F.col("before")).alias("number"))
    named = rows.join(number, "ord").withColumn("id", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("number").cast("string"))))
    return named.select("id", P.serialize(F.col("id"), F.col("description"), T.type_for_kind(F.col("kind")), F.col("scope"), F.col("kind"), F.col("extra"), F.col("text")).alias("content"))


def changed(topics: DataFrame, patches: DataFrame) -> DataFrame:
    """id, content of the topics that patches (id, text, description, kind, scope, extra; null: unchanged) change. Keys of extra are
    replaced one by one."""
    p = patches.select("id", *[F.col(c).alias(f"new_{c}") for c in ("text", "description", "kind", "scope", "extra")])
    j = topics.join(p, "id")
    as_map = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    mine, new = as_map(F.col("extra")), as_map(F.col("new_extra"))
    kept = F.map_filter(mine, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    extra = F.when(F.col("new_extra").isNull(), F.col("extra")).otherwise(F.to_json(F.to_variant_object(F.map_concat(kept, new))))
    name = F.when(F.col("name") == "", F.col("id")).otherwise(F.col("name"))
    said = F.when(F.col("new_description").isNull(), F.col("description")).otherwise(P.describe(F.col("new_description")))
    return j.select("id", P.serialize(name, said, F.col("type"), F.coalesce("new_scope", "scope"), F.coalesce("new_kind", "kind"), extra, F.coalesce("new_text", "body")).alias("content"))


def write_folder(files: DataFrame, uri: str) -> int:
    """Write (id, content) as files of a folder that the tasks can reach; unsafe ids are left out. A repeated task writes the same."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(uri)
        where.create_dir(at)
        for batch in batches:
            for name, content in zip(batch["id"], batch["content"]):
                with where.open_output_stream(f"{at}/{name}.md") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.filter(P.safe_id(F.col("id"))).mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _move(where, at: str, name: str) -> bool:
    """Move a file of a folder into its archive, under another name if it is there already; false if there is none."""
    from pyarrow import fs

    if where.get_file_info(f"{at}/{name}.md").type == fs.FileType.NotFound:
        return False
    to = f"{at}/archive/{name}.md"
    if where.get_file_info(to).type != fs.FileType.NotFound:
        to = f"{at}/archive/{name}.{time.time_ns() // 1_000_000:x}.md"
    where.move(f"{at}/{name}.md", to)
    return True


def archive_all(names: DataFrame, uri: str) -> None:
    """Move the files of names (id) into the folder's archive, in the tasks. Unsafe ids and ids without a file are left out, so a task that runs again finds
    nothing more to do."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(uri)
        where.create_dir(f"{at}/archive")
        for batch in batches:
            yield pd.DataFrame({"n": [sum(_move(where, at, name) for name in batch["id"])]})

    names.filter(P.safe_id(F.col("id"))).select("id").distinct().mapInPandas(put, "n long").agg(F.sum("n")).first()


def archive(uri: str, name: str) -> bool:
    """Move one file into the folder's archive, under another name if it is there already; false if there is none or the id is unsafe."""
    import re

    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(uri)
    if not re.fullmatch("[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
        return False
    where.create_dir(f"{at}/archive")
    return _move(where, at, name)


def entries(topics: DataFrame, asked: Column, unscoped_anywhere: bool = True, unscoped: str = "local") -> DataFrame:
    """id, text, kind, scope, metadata of topics (read_folder()): the text is the body or else the description, the kind the type if there is none, the scope
    the one asked (or `unscoped`) if the file has none; metadata is a JSON object of type, description, file and modified_ms, with the keys of extra over these."""
    base = F.struct("type", "description", "file", F.unix_millis(F.col("modified").cast("timestamp")).alias("modified_ms"))
    as_map = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    more, body = as_map(F.col("extra")), P.strip(F.coalesce("body", F.lit("")))
    own = F.map_filter(as_map(F.to_json(base)), lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return topics.select(
        "id", F.when(body != "", body).otherwise(F.col("description")).alias("text"), F.coalesce("kind", "type").alias("kind"),
        F.coalesce("scope", asked if unscoped_anywhere else F.lit(unscoped)).alias("scope"), F.to_json(F.to_variant_object(F.map_concat(own, more))).alias("metadata"),
    )


def search(topics: DataFrame, queries: DataFrame, limit: int = 10, unscoped_anywhere: bool = True, unscoped: str = "local") -> DataFrame:
    """query_id, scope, id, score, rank of each query (query_id, query, scopes) by tokens: the best `limit` of each scope, newest first
    among equals; a file found in several scopes counts for the first. Files without a scope match any scope, or only `unscoped`.

    Files are found by their words (see operators.index). Those that match any scope are scored once for a query; its best `limit` of them then go to
    each of its scopes, as no other can be among a scope's best.
    """
    asked = queries.select("query_id", T.file_tokens(F.col("query")).alias("tokens"), F.posexplode(F.array_distinct(F.filter("scopes", lambda s: s != ""))).alias("place", "scope")).filter(F.size("tokens") > 0)
    keys, fields = ["scope", "id", "modified"], {"nm": 3, "ds": 2, "dt": 1}
    own = F.col("scope") if unscoped_anywhere else F.coalesce("scope", F.lit(unscoped))
    files = topics.select(own.alias("scope"), "id", "modified", F.concat_ws(" ", "file", "name").alias("nm"), F.col("description").alias("ds"), F.col("body").alias("dt"))
    found = X.scores(files, keys, fields, asked.select("query_id", "scope", "tokens"), X.FILE_WORDS, (limit, {"modified": True, "id": False}))
    found = kept(found, "file-hits")
    mine = found.filter("scope is not null")
    best = [F.desc(F.col("raw") / (3 * F.col("n"))), F.desc("modified"), F.col("id")]
    homeless = found.filter("scope is null").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("r") <= limit).drop("r", "scope")
    places = asked.select("query_id", "scope", "place")
    rows = mine.join(places, ["query_id", "scope"]).unionByName(homeless.join(places, "query_id"))
    scored = rows.withColumn("score", F.col("raw") / (3 * F.col("n")))
    order = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), F.desc("modified"), "id")
    top = scored.select("query_id", "place", "scope", "id", "score", "modified").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    first = top.withColumn("w", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("place"))).filter("w = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place", "r"))
    return first.withColumn("rank", rank.cast("long")).select("query_id", "scope", "id", "score", "rank")
