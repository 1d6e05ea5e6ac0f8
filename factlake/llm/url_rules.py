"""URL filters by a sort-merge range join.

A rule's host, its labels reversed, is a prefix of the keys of exactly its host and subdomains, so it is an interval of sorted
keys, and intervals of rules are nested or apart. Rules and urls are cut by the same split points, sorted together, and swept
once; a stack holds the rules whose interval is open. Among those, the longest one whose path starts the url's path wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys on the driver from which the split points are taken.
SAMPLE_KEYS = 1 << 14
_LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot: the key of a domain is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All columns of `pages`, then host, path, rule (host and path of the rule that wins, or null) and verdict.

    rules: host, path, verdict. Of equal rules the first verdict in the alphabet holds; rules with a null or empty host fit nothing.
    Null urls and those without :// have an empty host and path, and the default verdict. A host that holds many of the urls is
    several split points at once: its urls are spread over all the parts between, and its rules are copied to each. Columns
    of `pages` named like the results are replaced. Repeated rows stay.
    """
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("key", host_key(F.col("host")))
    size = pages.count()
    sample = sorted(r.key for r in urls.select("key").sample(min(1.0, SAMPLE_KEYS / max(size, 1) / 2), seed=1).limit(SAMPLE_KEYS).collect())
    splits = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, salts: pd.Series) -> pd.Series:
        # A key between split points has one part; one equal to several has all the parts between them.
        return pd.Series([(a := bisect_left(splits, k)) + s % (bisect_right(splits, k) - a + 1) for k, s in zip(keys, salts, strict=True)])

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(splits, k), bisect_right(splits, k + _LAST) + 1)) for k in keys])

    salt = F.floor(F.rand(1) * (1 << 20))
    dealt = urls.withColumn("part", part_of("key", salt.cast("int")))
    wanted = rules.filter("host is not null and host <> ''").groupBy(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    spread = wanted.withColumn("part", F.explode(parts_of("key")))
    blank = F.lit(None).cast(urls.schema["rest"].dataType)
    both = dealt.select("part", "key", F.lit(False).alias("is_rule"), "host", "path", F.lit(None).cast("string").alias("verdict"), "rest").unionByName(spread.select("part", "key", F.lit(True).alias("is_rule"), "host", "path", "verdict", blank.alias("rest")))
    ordered = both.repartition("part").sortWithinPartitions("part", "key", F.desc("is_rule"))

    def longest(own: dict[str, str], lengths: list[int], host: str, path: str) -> tuple[int, str, str] | None:
        """Of one host's rules that with the longest path that starts this one: a look-up for each length that occurs."""
        for n in reversed(lengths[: bisect_right(lengths, len(path))]):
            if path[:n] in own:
                return len(host) + n, host + path[:n], own[path[:n]]
        return None

    def sweep(batches: Iterator) -> Iterator:
        # Keys of the open hosts, each inside the one before; each one's verdicts by path, these paths' lengths, and its host.
        stack: list[tuple[str, dict[str, str], list[int], str]] = []
        part = None
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            picked, found, verdicts = [], [], []
            for i, (p, key, is_rule, host, path, verdict) in enumerate(zip(*(column[n].to_pylist() for n in ("part", "key", "is_rule", "host", "path", "verdict")), strict=True)):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_rule:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, [], host))
                    own, lengths = stack[-1][1:3]
                    own[path] = verdict
                    place = bisect_left(lengths, len(path))
                    if place == len(lengths) or lengths[place] != len(path):
                        lengths.insert(place, len(path))
                    continue
                best = max((r for _, own, lengths, at in stack if (r := longest(own, lengths, at, path))), default=None)
                picked.append(i)
                found.append(best and best[1])
                verdicts.append(best[2] if best else default)
            take = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays([column["rest"].take(take), column["host"].take(take), column["path"].take(take), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["rest", "host", "path", "rule", "verdict"])

    text = T.StringType()
    schema = T.StructType([urls.schema["rest"], *(T.StructField(n, text) for n in ("host", "path", "rule", "verdict"))])
    return ordered.mapInArrow(sweep, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], "host", "path", "rule", "verdict")
