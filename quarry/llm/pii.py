"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the matches of strict patterns (the base, which always stays) and
of loose ones. Five labelers vote on each, for, against or not at all: the
strict pattern, the separators' shape, gazetteers (top-level domains, area
codes, issuer and network prefixes), the words before, and the edges. Over all
documents the candidates are counted by kind, votes and shape: a bounded table,
on which expectation maximisation estimates how reliable each labeler is and
how likely each candidate is real. With these as soft labels a logistic span
classifier is trained over votes and shape; loose candidates that it accepts
and that overlap no base span are added.

The texts are matched once: spans and codes are written, counted and answered
from there.

Defined cases: a null or empty text has no spans; repeated rows, and rows that
share a doc_id, are counted and answered each; a probability of just ACCEPT (a
tie) is accepted; very long texts are read whole; an empty table gives an empty
result; other columns of the input, whatever their names, are ignored. A loose
candidate that touches a base span, or an earlier accepted one of its kind, is
not added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches
from .store import written

KINDS = ("email", "ip", "card", "phone")
#: Loose candidates count as found from this probability on.
ACCEPT = 0.5
#: The classifier sees each kind as this many candidates, whatever the size of the corpus.
EVIDENCE = 2000.0

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: The contract's patterns, with possessive quantifiers and look-behinds that keep the matches and make them linear.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]++ ?[\[({<] ?at ?[\])}>] ?[a-z0-9-]++(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}([ .])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a kind's strict pattern, and its loose one, to be tried: a character, one of several, or a pattern.
NEEDED = {"email": ("@", r"(?i)[\[({<] ?at ?[\])}>]"), "ip": (".", ":"), "card": ("0123456789", "0123456789"), "phone": ("+", "0123456789")}

# Words and prefixes by which the labelers vote.
TLDS = "com net org edu gov mil int info biz io co ai dev app me us uk de fr es it nl eu ch at be se no fi dk pl pt ru cn jp in br au ca"
CUES = {
    "email": "mail|e-mail|email|contact|write|reach|address|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr|client|from|login|gateway|dns|node",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta|cc",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp|telefon|appel|llame",
}
AGAINST = "version|ver|release|isbn|issn|order|invoice|item|part|serial|page|section|chapter|build|sku|total|id"


def _holds(text: Column, chars: str) -> Column:
    """Whether text has one of the characters, or a match."""
    return text.contains(chars) if len(chars) == 1 else text.rlike(chars) if chars.startswith("(?i)") else F.length(F.translate(text, chars, "")) < F.length(text)


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    backward = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = backward.substr(i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _is_valid(kind: str, x: Column) -> Column:
    return _valid(kind, x["m"])


def base(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with an array of base spans for each kind."""
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")
    text = F.col("text")
    for kind in KINDS:
        docs = docs.withColumn(f"all_{kind}", F.when(_holds(text, NEEDED[kind][0]), matches(text, STRICT[kind])).otherwise(none))
        docs = docs.withColumn(kind, F.filter(f"all_{kind}", partial(_is_valid, kind))).drop(f"all_{kind}")
    return docs


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _votes(kind: str, x: Column, text: Column, strict: bool) -> list[Column]:
    """0 against, 1 none, 2 for."""
    m = F.lower(x["m"])
    before = F.lower(text.substr(F.greatest(F.lit(1), x["start"] - 29), F.least(F.lit(30), x["start"])))
    left, right = text.substr(x["start"], F.lit(1)), text.substr(x["end"] + 1, F.lit(1))
    glued = left.rlike(r"[\p{L}\p{N}]") & (x["start"] > 0) | right.rlike(r"[\p{L}\p{N}]")
    if kind == "email":
        known, unknown = m.rlike(f"(?:\\.|dot[\\])}}> ]+) ?(?:{TLDS.replace(' ', '|')})$"), m.rlike("[0-9]$")
        good, bad = ~m.rlike(r"\.\.|^[.%+-]"), m.rlike(r"\.\.|^[.%+-]")
    elif kind == "ip":
        known, unknown = ~m.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), m.rlike(r"^0\.|\.0\.0$")
        good, bad = ~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]")
    elif kind == "card":
        known, unknown = m.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6)"), m.rlike("^[0189]")
        good, bad = m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"), m.rlike("[ -][0-9][ -]")
    else:
        digits = F.regexp_replace(m, "[^0-9]", "")
        abroad = m.startswith("+")
        known = F.when(abroad, digits.rlike("^(?:1[2-9][0-8][0-9][2-9]|[2-9][0-9])")).otherwise(digits.rlike("^1?[2-9][0-8][0-9][2-9][0-9]{6}$"))
        unknown = F.when(abroad, digits.rlike("^(?:0|1[01])")).otherwise(digits.rlike("^(?:[01][0-9]{9}|[0-9]{3}[01][0-9]{6})$"))
        good, bad = m.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$"), m.rlike(r"[ .-]{2}|\(\)")
    cue, anti = before.rlike(f"(?:^|[^a-z])(?:{CUES[kind]})[^a-z0-9]{{0,4}}$|(?:^|[^a-z])(?:{CUES[kind]})[^a-z0-9]+[a-z]+[^a-z0-9]{{1,3}}$"), before.rlike(f"(?:^|[^a-z])(?:{AGAINST})(?: (?:no|nr|number))?[^a-z0-9]{{0,4}}$")
    return [F.lit(2 if strict else 1), _vote(good, bad), _vote(known, unknown), _vote(cue, anti), _vote(~glued, glued)]


LABELERS, LENGTHS, SHARES = 5, 4, 4


def _shape(x: Column) -> list[Column]:
    """Length and share of digits, in four steps each."""
    n = F.length(x["m"])
    share = F.length(F.regexp_replace(x["m"], "[^0-9]", "")) / n
    return [F.when(n <= 12, 0).when(n <= 16, 1).when(n <= 24, 2).otherwise(3), F.when(share <= 0.1, 0).when(share <= 0.5, 1).when(share <= 0.85, 2).otherwise(3)]


def _coded(kind: str, x: Column, text: Column, strict: bool) -> Column:
    """Kind, votes and shape in one number."""
    code = F.lit(KINDS.index(kind))
    for v, base_ in zip([*_votes(kind, x, text, strict), *_shape(x)], [3] * LABELERS + [LENGTHS, SHARES], strict=True):
        code = code * base_ + v
    return code.cast("int")


def decoded(code: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Kind, votes, shape."""
    rest, out = code, []
    for base_ in (SHARES, LENGTHS, *[3] * LABELERS):
        rest, v = divmod(rest, base_)
        out.append(v)
    out.reverse()
    return rest, tuple(out[:LABELERS]), tuple(out[LABELERS:])


def _as_code(kind: str, x: Column) -> Column:
    return _coded(kind, x, F.col("text"), True)


def _as_candidate(kind: str, x: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _coded(kind, x, F.col("text"), False).alias("code"))


def _as_span(kind: int, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def candidates(docs: DataFrame) -> DataFrame:
    """base(docs) with `loose`: array of (kind, start, end, code) clear of base spans, and `codes`: of all candidates."""
    found = base(docs)
    text = F.col("text")
    loose, strict = [], []
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")
    for kind in KINDS:
        found = found.withColumn(f"loose_{kind}", F.when(_holds(text, NEEDED[kind][1]), matches(text, LOOSE[kind])).otherwise(none))
    for kind in KINDS:
        def clear(x: Column) -> Column:
            hit = F.lit(False)
            for other in KINDS:
                hit = hit | F.exists(other, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            return ~hit

        loose.append(F.transform(F.filter(f"loose_{kind}", clear), partial(_as_candidate, kind)))
        strict.append(F.transform(kind, partial(_as_code, kind)))
    found = found.withColumn("loose", F.concat(*loose))
    return found.withColumn("codes", F.concat(*strict, F.transform("loose", lambda x: x["code"]))).drop(*(f"loose_{k}" for k in KINDS))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation maximisation by kind: (prior, P(vote | real or not) of each labeler), and P(real) of each (kind, votes)."""
    by_kind: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for code, n in counts.items():
        kind, votes, _ = decoded(code)
        by_kind[kind][votes] += n
    models, belief = {}, {}
    for kind, rows in sorted(by_kind.items()):
        votes = np.array(sorted(rows))
        n = np.array([rows[tuple(v)] for v in votes], float)
        p = np.clip(0.5 + 0.12 * (votes - 1).sum(1), 0.05, 0.95)
        for _ in range(rounds):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            log = np.stack([np.full(len(n), math.log(1 - prior)), np.full(len(n), math.log(prior))])
            table = np.zeros((2, LABELERS, 3))
            for real, w in ((0, n * (1 - p)), (1, n * p)):
                for k in range(LABELERS):
                    # a vote speaks for its side before anything is seen
                    table[real, k] = np.bincount(votes[:, k], w, 3) + ((2, 2, 8) if real else (8, 2, 2))
                    table[real, k] /= table[real, k].sum()
                    log[real] += np.log(table[real, k, votes[:, k]])
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        models[kind] = (prior, table)
        belief.update({(kind, tuple(v)): float(x) for v, x in zip(votes.tolist(), p, strict=True)})
    return models, belief


def _features(code: int) -> list[int]:
    """Places of the features that are 1; the first labeler, which tells base from loose, is left out."""
    kind, votes, shape = decoded(code)
    out, at = [kind], len(KINDS)
    for k in range(1, LABELERS):
        out.append(at + kind * 3 + votes[k])
        at += 3 * len(KINDS)
    out += [at + kind * LENGTHS + shape[0], at + LENGTHS * len(KINDS) + kind * SHARES + shape[1]]
    return out


def classifier(counts: dict[int, int], belief: dict, rounds: int = 300, penalty: float = 1.0) -> dict[int, float]:
    """P(real) of every code that occurs, by logistic regression on soft labels."""
    codes = sorted(counts)
    width = len(KINDS) * (1 + 3 * (LABELERS - 1) + LENGTHS + SHARES)
    x = np.zeros((len(codes), width))
    for i, code in enumerate(codes):
        x[i, _features(code)] = 1
    y = np.array([belief[decoded(c)[:2]] for c in codes])
    # roots of the counts, as shares of their kind: common shapes don't outweigh the rest, and a larger corpus changes nothing
    n = np.array([counts[c] for c in codes], float) ** 0.5
    kinds = np.array([decoded(c)[0] for c in codes], int)
    n *= EVIDENCE / np.bincount(kinds, n, len(KINDS))[kinds] if n.size else 1.0
    w = np.zeros(width)
    for _ in range(rounds):  # Newton's method would do; plain steps need no inverse
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (p - y)) + penalty * w
        step = x.T @ (n * np.maximum(p * (1 - p), 0.05)) * 7 + penalty
        w -= gradient / step
    return dict(zip(codes, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base arrays by kind, and `added`: array of (kind, start, end)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(spark, candidates(texts).drop("text"), "spans")
    # at most 4 * 3^5 * 16 rows, whatever the corpus
    counts = {r[0]: r[1] for r in found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()}
    _, belief = reliabilities(counts)
    accepted = sorted(c for c, p in classifier(counts, belief).items() if p >= ACCEPT and decoded(c)[1][0] == 1)
    added = F.filter("loose", lambda x: x["code"].isin(accepted))
    return found.withColumn("added", F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop("loose", "codes")


def _base_spans() -> Column:
    return F.concat(*(F.transform(k, partial(_as_span, i)) for i, k in enumerate(KINDS)))


def _joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base", _base_spans())
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's rows without the spans that the method adds, which SQL can't express."""
    return op1_pii(spark, sf_dir).drop("spans")
