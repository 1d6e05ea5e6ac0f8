"""Topic files: their text format as Column expressions, in both directions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions.text import WHITE, slug, squeeze, type_for_kind

# The types, and files of a folder that hold no topic.
TYPES = ["user", "feedback", "reference", "project"]
INDEX_FILES = ["MEMORY.md", "MEMORY-overflow.md"]
_HEAD = "^---\\n((?s:.*?))\\n---"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once: a lambda's variable isn't replaced by what it stands for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def unquote(text: Column) -> Column:
    """A scalar without its quotes and their escapes, white space squeezed."""

    def bare(s: Column) -> Column:
        middle = F.substring(s, F.lit(2), F.length(s) - 2)
        double = F.replace(F.replace(middle, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        single = F.replace(middle, F.lit("''"), F.lit("'"))
        around = lambda q: (F.length(s) >= 2) & s.startswith(q) & s.endswith(q)
        return squeeze(F.when(around('"'), double).when(around("'"), single).otherwise(s))

    return _with(strip(text), bare)


def parse(content: Column) -> Column:
    """name, description, type, scope, kind, extra (JSON text of an object, else null) and body of a topic file, as a struct.

    Lenient: without a head everything is body; unknown types are `project`; a type at the top goes before a nested one; null is an
    empty file.
    """
    whole = F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return _with(whole, lambda text: _with(F.regexp_extract(text, _HEAD, 1), lambda head: _fields(text, head)))


def _fields(text: Column, head: Column) -> Column:
    # Without a head the pattern leaves the text as it is.
    body = F.regexp_replace(F.regexp_replace(text, _HEAD, ""), "^\\n+|\\n+$", "")
    line = lambda key, indent="": strip(F.regexp_extract(head, f"(?m)^{indent}{key}:[ \\t]*(.+)$", 1))
    nested = lambda key: line(key, "[ \\t]+")
    filled = lambda c: F.when(c != "", c)
    kind = F.lower(unquote(F.coalesce(filled(line("type")), nested("type"))))
    return F.struct(
        unquote(line("name")).alias("name"), unquote(line("description")).alias("description"), _with(kind, lambda k: F.when(k.isin(TYPES), k).otherwise("project")).alias("type"),
        _with(unquote(nested("scope")), filled).alias("scope"), _with(unquote(nested("kind")), filled).alias("kind"),
        _with(nested("extra"), lambda x: F.when(F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>").isNotNull(), x)).alias("extra"), body.alias("body"),
    )


def serialize(name: Column, description: Column, type_: Column, scope: Column, kind: Column, extra: Column, body: Column) -> Column:
    """The text that parse() reads; null or empty scope, kind and extra (or an empty object) are left out."""
    quoted = F.replace(F.replace(squeeze(description), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    field = lambda key, c: F.when((c != "") & (c != "{}"), F.concat(F.lit(f"  {key}: "), c))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("name: "), name), F.concat(F.lit('description: "'), quoted, F.lit('"')), F.lit("metadata:"), F.lit("  node_type: memory"),
        F.concat(F.lit("  type: "), type_), field("scope", scope), field("kind", kind), field("extra", extra), F.lit("---"), F.lit(""), strip(F.coalesce(body, F.lit(""))), F.lit(""),
    )


def describe(text: Column, most: int = 140) -> Column:
    """The first sentence of ten characters or more in the first line that is neither blank, heading nor rule; else that line; cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---"))

    def cut(first: Column) -> Column:
        sentence = F.regexp_extract(F.concat(first, F.lit(" ")), "^(.{10,}?[.!?])\\s", 1)
        flat = squeeze(F.when(sentence != "", sentence).otherwise(first))
        return _with(flat, lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.left(x, F.lit(most - 1)), f"{WHITE}$", ""), F.lit("…"))))

    return _with(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), cut)


def base_id(kind: Column, description: Column) -> Column:
    return F.concat(type_for_kind(kind), F.lit("_"), slug(description))


def safe_id(name: Column) -> Column:
    """Whether a name can't leave its folder."""
    return name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*\\z") & ~name.contains("..")


def distinctive_token(text: Column) -> Column:
    """The longest token of six characters or more, the first of those; else the text's first twelve characters."""

    def first_longest(low: Column) -> Column:
        # One pass: of what was seen so far, the first of the longest.
        tokens = F.filter(F.split(low, "[^a-z0-9-]+"), lambda t: F.length(t) >= 6)
        best = F.aggregate(tokens, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
        return _with(best, lambda t: F.when(t != "", t).otherwise(F.left(low, F.lit(12))))

    return _with(F.lower(F.coalesce(text, F.lit(""))), first_longest)
