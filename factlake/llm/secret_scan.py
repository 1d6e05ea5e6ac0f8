"""Secret scans in DataFrame functions only: base patterns, and a likelihood ratio of character Markov models.

Two first-order models, of random strings and of ordinary identifiers, are counted from labelled samples. A long token is a secret
if its log-likelihood ratio speaks for the random model, in all and per character. Positions come from what lies between the
matches: the lengths of the pieces that a pattern cuts a text into, and of its matches, add up to each match's place. Such running
sums and maxima are made by doubling, in n log n steps, so a text may hold very many matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import few_rows

# Patterns of the base kinds (in this order), the group whose length counts, and its least length.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
MARKOV = "markov"
KINDS = [*BASE, MARKOV]
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Distinct texts from which the models are counted, about (a parameter of labelled_samples), and generated random strings.
SAMPLE_ROWS, SAMPLE_STRINGS = 2_000, 2_000
#: Least log-likelihood ratio of a token, in all and for each pair of characters (nats).
LEAST_RATIO, LEAST_MEAN = 15.0, 0.8
_CLASSES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WIDTH = len(_CLASSES) + 1
#: Code points of the pieces that a text is cut into where parts of it are taken.
_PIECE = 1024

# Words of ordinary identifiers.
IDENTIFIER_WORDS = (
    "account action address array buffer cache callback channel check client column config connection content context controller count create current data database date default delete document element error event example factory field file filter format function get global group handler header image index input instance internal item key label language length level library limit list loader local manager map message method model module name network node number object option order output package page parameter parent parser path pattern position process product project property public query random read record reference register report request resource response result return row run schema score search section selector server service session set size source start state status stream string style system table target task template test text thread time title type update url user util value vector version view window write"
).split()


def _codes(token: Column) -> Column:
    """Each character's class as an array of int; those outside the alphabet share one."""
    table = ",".join(str(_CLASSES.index(chr(i)) if chr(i) in _CLASSES else _WIDTH - 1) for i in range(128))
    lookup = F.split(F.lit(table), ",").cast("array<int>")
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(lookup, F.ascii(c)), F.lit(_WIDTH - 1)))


def _pairs(codes: Column) -> Column:
    """Numbers of the pairs of neighbouring characters."""
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * _WIDTH + b)


def labelled_samples(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """token, secret: what the base patterns find and generated random strings (true); the other words of a bounded sample of the texts
    (about `rows`; see few_rows, so it doesn't depend on how the table is cut) and composed identifiers (false)."""
    spark = docs.sparkSession
    found = F.concat(*[F.regexp_extract_all("t", F.lit(p), g) for p, g, _ in BASE.values()])
    rest = F.col("t")
    for p, _, _ in BASE.values():
        rest = F.regexp_replace(rest, p, " ")
    words = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_-]{4,}"), 0))
    least = max(n for _, _, n in BASE.values())
    labelled = lambda tokens, secret: F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(secret).alias("secret")))
    seen = few_rows(docs, text, rows).select(F.explode(F.concat(labelled(F.filter(found, lambda x: F.length(x) >= least), True), labelled(words, False))).alias("x")).select("x.token", "x.secret")
    made = spark.range(SAMPLE_STRINGS, numPartitions=1)
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = made.select(F.explode(F.array(F.translate(F.base64(F.unhex(digest)), "=", ""), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), F.conv(F.substring(digest, 20, 15), 16, 36))).alias("token"), F.lit(True).alias("secret"))
    lookup = F.split(F.lit(",".join(IDENTIFIER_WORDS)), ",")
    word = lambda a: F.get(lookup, F.pmod(F.xxhash64(F.col("id"), F.lit(a)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    three = [word(i) for i in range(3)]
    plain = made.select(F.explode(F.array(F.concat_ws("_", *three), F.upper(F.concat_ws("_", *three)), F.concat_ws("-", *three), F.concat_ws("/", *three), F.concat(three[0], F.initcap(three[1]), F.initcap(three[2])), F.concat(*[F.initcap(x) for x in three], (F.col("id") % 100).cast("string")))).alias("token"), F.lit(False).alias("secret"))
    return seen.unionByName(random).unionByName(plain)


def fit_markov(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of character classes (random against ordinary), smoothed by one count."""
    counted = samples.select("secret", F.explode(_pairs(_codes(F.col("token")))).alias("pair")).groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n"))
    n = {(r.secret, r.pair): r.n for r in counted.collect()}  # at most two for each pair of classes

    def rates(secret: bool) -> list[float]:
        out = []
        for a in range(_WIDTH):
            row = [n.get((secret, a * _WIDTH + b), 0) + 1 for b in range(_WIDTH)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [x - y for x, y in zip(rates(True), rates(False), strict=True)]


def log_ratio(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(_pairs(_codes(token)), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, both) -> Column:
    """Of an array of long, the sums (or what `both` makes of two) of each element and all before it, by doubling. 0 must be neutral."""
    shifts = F.array(*[F.lit(1 << i) for i in range(31)])

    def step(acc: Column, s: Column) -> Column:
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0).cast("long"), s), F.slice(acc, F.lit(1), F.size(acc) - s)), both)

    return _let(values, lambda v: F.aggregate(F.filter(shifts, lambda s: s < F.size(v)), v, step))


def _spans(text: Column, pattern: str, kind: int, good) -> Column:
    """Matches of a pattern as structs (start, kind, stop, match) in code points, of those for which good(match) holds."""

    def placed(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        ends = _running(sizes, lambda a, b: a + b)
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("stop"), m.alias("match")))

    return F.filter(_let(F.regexp_extract_all(text, F.lit(pattern), 0), placed), good)


def _long_enough(pattern: str, group: int, least: int):
    """Whether a match's group has so many characters."""
    return lambda x: F.length(F.regexp_extract(x["match"], pattern, group)) >= least


def find_secrets(docs: DataFrame, text: str = "text", model: list[float] | None = None) -> DataFrame:
    """All columns of `docs` with secrets: an array of (start, kind, stop), by start, then kind (an index of KINDS). Positions count
    code points, ends are exclusive.

    Base kinds are leftmost matches that do not overlap within their kind; matches too short are dropped. Tokens that the models
    call random are added unless a base span holds the whole of them. The models are counted from a bounded sample unless given. Null
    and empty texts have none, an empty table stays empty, repeated rows get equal spans. Whole texts are scanned; rows are
    independent. A column named `secrets` is replaced, all others stay, whatever their names. No Python runs.
    """
    model = model or fit_markov(labelled_samples(docs, text))
    rest = [c for c in docs.columns if c != "secrets"]
    kept = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<none:int>")
    out = docs.select(kept.alias("rest"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    t, none = F.col("t"), F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint,match:string>>)")
    found = [F.when(t.rlike(pattern), _spans(t, pattern, i, _long_enough(pattern, group, least))).otherwise(none) for i, (pattern, group, least) in enumerate(BASE.values())]
    random = lambda x: _let(log_ratio(x["match"], model), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_MEAN * (F.length(x["match"]) - 1)))
    found.append(F.when(t.rlike(TOKEN), _spans(t, TOKEN, len(BASE), random)).otherwise(none))
    bare = F.transform(F.concat(*found), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))

    def free(spans: Column) -> Column:
        """Without the models' spans that end inside a base span that begins before them."""
        covered = _running(F.transform(spans, lambda x: F.when(x["kind"] < len(BASE), x["stop"]).otherwise(F.lit(0).cast("long"))), lambda a, b: F.greatest(a, b))
        both = F.zip_with(spans, covered, lambda x, c: F.struct(x.alias("span"), ((x["kind"] < len(BASE)) | (x["stop"] > c)).alias("stays")))
        return F.transform(F.filter(both, lambda x: x["stays"]), lambda x: x["span"])

    return out.select("rest", _let(F.array_sort(bare), free).alias("secrets")).select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], "secrets")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", model: list[float] | None = None) -> DataFrame:
    """The columns of `docs`, each secret of the text replaced by `mask`; secrets that overlap become one. Null texts stay null, texts
    without secrets as they are; an empty table stays empty, other columns may have any names."""
    found = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("t")), "t", model)
    t = F.col("t")

    def masked(pieces: Column, spans: Column, reach: Column) -> Column:
        """reach: how far the spans up to each one go. What lies between goes through the pieces, so that no place is counted from the
        text's start."""

        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / _PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / _PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, (a % _PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(reach, F.lit(1), F.size(reach) - 1))
        gaps = F.filter(F.zip_with(spans, before, lambda x, r: F.struct(r.alias("a"), x["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        return F.array_join(F.concat(F.transform(gaps, lambda g: part(g["a"], g["b"])), F.array(part(F.element_at(reach, -1), F.length(t).cast("long")))), mask)

    cut = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_PIECE}}}"), 0)
    reach = _running(F.transform("secrets", lambda x: x["stop"]), lambda a, b: F.greatest(a, b))
    new = F.when(F.size("secrets") > 0, _let(cut, lambda p: _let(reach, lambda r: masked(p, F.col("secrets"), r)))).otherwise(t)
    return found.select(*[new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
