"""The training-data operators as queries over the driver's tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe, collocations, exact_dedup, ngram_join, packing, quality, secret_scan, spelling, substring_dedup, token_counts, token_shards, url_rules, vector_blocks
from factlake.llm.common import Workspace

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: The key of the permutation of the training order.
ORDER_KEY = 20240229
# Verdict, host and path of each url rule.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    found = url_rules.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.transcode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    names = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("secrets", lambda x: x["kind"] == i)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < len(secret_scan.BASE))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.BASE)], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_blocks.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), keep_ids=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir).select("doc_id", "text")).drop("text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Workspace(spark, "shards").root  # gone when Python exits, or with Workspace.clear()
    ordered = token_shards.stored_order(_documents(spark, sf_dir), tokenizer_path(), at, ORDER_KEY)
    return ordered.withColumnRenamed("keys", "doc_ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def _slip(run: bytes, start: int) -> bytes:
    """The run, without one of its characters where 31 divides the CRC-32 of the document's number, a colon and the run."""
    h = zlib.crc32(run, start)
    if h % 31:
        return run
    t = run.decode()
    at = h % len(t)
    return (t[:at] + t[at + 1 :]).encode()


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_documents(spark, sf_dir).select("doc_id", "text"), slip=_slip)
    return spelling.variants(words.filter("n >= 2"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_url_filter, op3_bpe, op4_substring_dedup, op5_secret_scan, op6_nearest, op7_packing, op8_quality, op9_training_order, op10_token_counts, op11_spelling, op12_phrases, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _URLS, "op6_nearest": _NEAREST, "op12_phrases": _PHRASES, "op13_exact_dedup": _COPIES}


_URLS = """
WITH parts AS (
  SELECT page_id, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS r
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT cut.page_id, cut.host, cut.path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fits ON fits.page_id = cut.page_id AND r = 1
"""

_NEAREST = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) AS p
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, p, k, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT * FROM f WHERE a >= 30
), parts AS (
  SELECT lang, p, a, unnest(range(1, k)) AS cut FROM often WHERE k > 1
), cuts AS (
  SELECT c.lang, c.p, c.a, cut, h.a AS l, t.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (h.a + t.a) AS score
  FROM parts c JOIN often h ON h.lang = c.lang AND h.p = c.p[1:cut] JOIN often t ON t.lang = c.lang AND t.p = c.p[cut + 1:]
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, p[o:o + j - 1] AS p, max(a) AS longer
  FROM often, (SELECT unnest([1, 2, 3]) AS o), (SELECT unnest([2, 3]) AS j) WHERE j < k AND o + j - 1 <= k GROUP BY ALL
), left_ AS (
  SELECT w.lang, array_to_string(w.p, ' ') AS phrase, a, l, r, score FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.p = w.p
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_
)
SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""

_COPIES = """
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM bare WINDOW g AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""
