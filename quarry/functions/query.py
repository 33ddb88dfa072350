"""Query syntax and word forms. A query is short, so it is parsed on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FIELDS

# Fixed values.
WEIGHT = re.compile(r"^([a-zA-Z_]+):(-?[0-9]*\.?[0-9]+)$")
ALIASES = {"summary": "summaries"}
COMMON_WORDS = frozenset("a an and are as at be by for from in is it of on or the to with".split())
ES_ENDINGS = ("ses", "xes", "zes", "ches", "shes")
SIBILANTS = ("s", "x", "z", "ch", "sh")


def parse(query: str | None, correct: Callable[[str], str] = str, fields: tuple[str, ...] = FIELDS, default: float = 1.0) -> tuple[dict[str, float], list[str]]:
    """(weight of each field, terms in order). `name:number` sets a weight if the field is known, else it is a term."""
    weights = dict.fromkeys(fields, default)
    terms = []
    for part in (query or "").replace('"', " ").replace("'", " ").split():
        m = WEIGHT.match(part)
        name = ALIASES.get(m[1], m[1]) if m else None
        if name in weights:
            weights[name] = max(0.0, float(m[2]))
        else:
            terms.append(correct(part.lower()))
    return weights, " ".join(terms).lower().split()


def valid_weights(weights: dict[str, float], fields: tuple[str, ...] = FIELDS) -> bool:
    """Whether all fields are known and all weights numbers; negative ones pass."""
    return all(f in fields and isinstance(w, (int, float)) for f, w in weights.items())


def clamped(weights: dict[str, float]) -> dict[str, float]:
    return {f: max(w, 0.0) if w < 0 else w for f, w in weights.items()}


def parse_valid(query: str | None, correct: Callable[[str], str] = str) -> tuple[dict[str, float], list[str]]:
    weights, terms = parse(query, correct)
    return clamped(weights if valid_weights(weights) else dict.fromkeys(FIELDS, 1.0)), terms


def effective(weights: dict[str, float]) -> dict[str, float]:
    """Weights as scoring takes them: none is zero, so a field never drops out."""
    return {f: w if w > 0 else 0.01 for f, w in weights.items()}


def ngrams(terms: list[str]) -> list[list[str]]:
    """Windows of three terms, then of two; each distinct one once, at its first place."""
    seen: dict[str, list[str]] = {}
    for n in (3, 2):
        for i in range(len(terms) - n + 1):
            seen.setdefault(" ".join(terms[i : i + n]), terms[i : i + n])
    return list(seen.values())


def _ends(w: Column, endings: tuple[str, ...]) -> Column:
    return w.rlike("(?:" + "|".join(endings) + ")$")


def plural_class(w: Column) -> Column:
    n = F.length(w)
    return F.when(w.endswith("ies") & (n > 3), "IES").when(_ends(w, ES_ENDINGS) & (n > 3), "ES").when(w.endswith("s") & (n > 1), "S").otherwise("NONE")


def plural_base(w: Column) -> Column:
    """The likely singular, or the empty string."""
    n = F.length(w)
    return (
        F.when(n <= 2, "")
        .when(w.endswith("ies") & (n > 3), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(_ends(w, ES_ENDINGS), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.endswith("ss"), F.left(w, n - 1))
        .otherwise("")
    )


def variants(w: Column) -> Column:
    """Singular and plural forms, whether words or not; distinct, without the empty string."""
    none = F.lit(None).cast("string")
    forms = F.array(
        plural_base(w),
        F.when(w.rlike("[^aeiou]y$"), F.concat(F.left(w, F.length(w) - 1), F.lit("ies"))).otherwise(none),
        F.when(_ends(w, SIBILANTS), F.concat(w, F.lit("es"))).otherwise(none),
        F.concat(w, F.lit("s")),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))
