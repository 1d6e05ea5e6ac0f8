"""The quality gate of compound entities, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions.text import WHITE

# Function words, words of clauses, gerunds that modify nouns, vague leading words.
STOP = "the a an of in on at to for and or but so is was are were be been being it its this that these those with as by from just else before after nothing something anything one mid re ve ll no not than then up out off over per via their there here when while into onto about above below against through during without between among because although though if until unless whether which who whom whose what where why how has have had do does did will would could should may might must".split()
CLAUSE = "against and or but so because although though if when while until unless then than whether which who whom whose what where why how is was are were be been being has have had do does did will would could should may might must".split()
GERUNDS = "embedding building testing training routing running linking indexing caching logging parsing streaming rendering deploying releasing scoping staging handling loading writing reading searching matching ranking federating migrating processing querying fetching syncing spawning checkpointing compacting orchestrating scheduling validating reviewing working waiting passing failing".split()
VAGUE = "actual apparent different entire false genuine likely new only other possible potential prior previous real same single true whole".split()
# Patterns of signs that no entity has, of nouns made of other words, of plurals and of what only looks like them.
SIGNS = "[`\"|()\\[\\]{}+,;:!?<>—–]"
NOMINAL, PLURAL, NO_PLURAL = "(?:tion|sion|ment|ance|ence|ity|ness|al)$", "s$", "(?:ss|us|is)$"


def low_quality(entity: Column) -> Column:
    """Whether a compound entity is a fragment of a sentence rather than a noun phrase; null and empty ones are."""
    # White space is Unicode's, not only ASCII's.
    low = F.regexp_replace(F.lower(F.coalesce(entity, F.lit(""))), f"^{WHITE}|{WHITE}$", "")
    text = F.regexp_replace(low, f"^(?:the|a|an){WHITE}", "")
    words = F.filter(F.transform(F.split(text, WHITE), lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", "")), lambda w: w != "")
    size, first, last = F.size(words), F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    tail = F.slice(words, 2, F.greatest(size - 1, F.lit(0)))
    return (
        (size < 2) | first.isin(STOP) | last.isin(STOP) | text.rlike(SIGNS) | F.exists(words, lambda w: w.isin(CLAUSE))
        | ((size >= 3) & F.exists(words, lambda w: w.rlike("['’]s$")))
        | ((F.length(first) >= 8) & first.endswith("ing") & ~first.isin(GERUNDS))
        | ((size >= 3) & first.isin(VAGUE) & F.exists(tail, lambda w: (F.length(w) >= 5) & w.rlike(NOMINAL)) & last.rlike(PLURAL) & ~last.rlike(NO_PLURAL))
        | ~F.exists(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP) & w.rlike("[a-z]"))
    )
