"""Text analysis as column expressions: cleaning, tokens, lemmas.

Java's `\\s` knows ASCII only, so patterns that must see Unicode white space say
so, with the four separators \\x1c-\\x1f.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FIELDS = ("title", "summaries", "genres", "stars")
STOP_WORDS = "a an and are as at be by for from has he her his in is it its of on or that the their this to was were with who when where".split()
SHORT_LEMMAS = ("tv", "dc", "mc")
PLACEHOLDERS = (
    "summary not found.",
    "failed to extract summary.",
    "languages not found.",
    "failed to extract languages.",
    "release year not found.",
    "failed to extract release year.",
)
COMPOUNDS = {
    "spider-man": "spiderman spider man",
    "iron-man": "ironman iron man",
    "captain-america": "captainamerica captain america",
    "fast-furious": "fastfurious fast furious",
}
URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
DROPPED = r"(?U)[^a-z0-9\s\x1c-\x1f.,!?;:]"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def has_placeholder(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, (low.contains(p) for p in PLACEHOLDERS))


def clean(text: Column) -> Column:
    """Lower-cased text of words, digits and basic punctuation; the order of the steps matters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = F.when(low.contains("http") | low.contains("www."), F.regexp_replace(low, URL, "")).otherwise(low)  # few texts need the pattern
    for gone in PLACEHOLDERS:
        t = F.replace(t, F.lit(gone), F.lit(""))
    for name, parts in COMPOUNDS.items():
        t = F.replace(t, F.lit(name), F.lit(parts))
    t = F.regexp_replace(F.replace(t, F.lit("-"), F.lit(" ")), DROPPED, "")
    return F.trim(F.regexp_replace(t, BLANKS, " "))


def lemma(w: Column) -> Column:
    """The first suffix rule that fits."""
    n = F.length(w)
    cut = lambda k: F.left(w, n - k)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing") & (n > 5), cut(3))
        .when(w.endswith("ed") & (n > 4), cut(2))
        .when(w.endswith("s") & (n > 3), cut(1))
        .otherwise(w)
    )


def tokens(cleaned: Column) -> Column:
    """Lemmas of a cleaned text: no stop words, all letters or all digits, longer than two characters."""
    words = F.regexp_extract_all(F.lower(cleaned), F.lit("([a-z0-9]+)"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & w.rlike("^(?:[a-z]+|[0-9]+)$"))
    return F.filter(F.transform(words, lemma), lambda w: (F.length(w) > 2) | w.isin(*SHORT_LEMMAS))


def flattened(items: Column, separator: str) -> Column:
    """A list field as text, without its empty items."""
    return F.array_join(F.filter(items, lambda x: x != ""), separator)
