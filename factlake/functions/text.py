"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CAP = 32
# White space of the store's text comparison (Unicode, not only ASCII).
WHITE = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def lexical_tokens(text: Column, cap: int = TOKEN_CAP) -> Column:
    """Distinct tokens of [a-z0-9_-] with two characters at least, then the parts of compounds, the first `cap` of all."""
    whole = F.filter(F.split(_lower(text), "[^a-z0-9_-]+"), lambda t: F.length(t) >= 2)
    parts = F.flatten(F.transform(F.filter(whole, lambda t: t.rlike("[_-]")), lambda t: F.filter(F.split(t, "[_-]+"), lambda p: F.length(p) >= 2)))
    return F.slice(F.array_distinct(F.concat(whole, parts)), 1, cap)


def file_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def field_score(tokens: Column, name: Column, description: Column, data: Column) -> Column:
    """For each token 3 if the name contains it, else 2 for the description, else 1 for the data. The fields are lower-cased already."""
    one = lambda t: F.when(F.contains(name, t), 3).when(F.contains(description, t), 2).when(F.contains(data, t), 1).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda total, t: total + one(t))


def token_words(text: Column) -> Column:
    """The text's distinct runs of token characters, in lower case, with a blank between: it contains the same tokens, and is shorter."""
    return F.array_join(F.array_distinct(F.split(_lower(text), "[^a-z0-9_-]+")), " ")


def token_scores(tokens: Column, name: Column, description: Column, data: Column) -> Column:
    """field_score() of each of these tokens by itself. The fields are bound once, or they would be computed again for every token."""
    fields = F.array(F.struct(name.alias("n"), description.alias("d"), data.alias("t")))
    one = lambda f, t: F.when(F.contains(f["n"], t), 3).when(F.contains(f["d"], t), 2).when(F.contains(f["t"], t), 1).otherwise(0)
    return F.get(F.transform(fields, lambda f: F.transform(tokens, lambda t: one(f, t))), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def trigrams(text: Column) -> Column:
    t = F.lower(squeeze(text))
    n = F.length(t)
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def slug(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(_lower(text), "[^a-z0-9\\s_-]", " "), "[\\s_-]+"), lambda w: w != "")
    made = F.array_join(F.slice(words, 1, 7), "_")
    return F.when(made == "", "memory").otherwise(made)


def type_for_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin("identity", "user"), "user").when(k.isin("preference", "correction", "feedback"), "feedback").when(k == "reference", "reference").otherwise("project")
