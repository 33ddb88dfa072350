"""Secret scanning with a random forest that removes false positives, in DataFrame operations only.

Candidates are whatever may be a secret, and the rest is left to the forest:
private-key headers; runs of letters, digits and `+/_-` with a digit, of LEAST
characters or more; tokens that begin as issuers' tokens do; any value, quoted or
not, that follows a credential word and a separator; and passwords in URLs. Of
overlapping ones the first and longest counts. Each has the numbers of FEATURES:
length, character transitions, distinct characters, dictionary coverage, its path
and the words around it. The forest is trained on the driver from labelled
findings (of more than FINDINGS, a sample by hash; the defaults are generated from
the rules below, by a fixed seed) and sent as one constant, which a fold over its
levels evaluates.

Defined cases: a null or empty text has no candidates; a null path is none;
repeated rows are answered each; a probability of just ACCEPT (a tie) is a secret;
very long texts are read whole; an empty table gives an empty result. All columns
of the input stay but those named `candidates` and `secrets`, which are replaced;
no other name can clash.
"""

from __future__ import annotations

import hashlib
import json
import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches

LEAST = 16
#: Labelled findings that are used for training at most.
FINDINGS = 4000
TREES, DEPTH = 25, 6
ACCEPT = 0.5
MASK = "[SECRET]"

# Words around findings, words inside harmless names, parts of paths, and how issuers' tokens begin.
CUES = "password passwd pwd secret token api_key apikey api-key access_key auth bearer credential private_key client_secret key aws passphrase"
HARMLESS = "example sample test dummy placeholder sha sha1 sha256 md5 commit checksum hash digest uuid guid id revision etag integrity build version file isbn"
WORDS = "the and for that with this from have not you are was will name user data file list page test main index value type time date item code text size line next last first call info node view form model table event error state order image style class field group local global config server client message request response default example sample public static return import export version number string array object please required none null true false optional enter your here changeme environment secret password token key"
PATHS = "test tests example examples sample samples mock fixture fixtures docs vendor node_modules lock"
ISSUERS = "gh[pousr]_ xox[abprs]- sk[-_] glpat- npm_ AIza eyJ"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


TOKENS = (
    r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
    rf"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
    rf"|(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{{16}}(?![A-Za-z0-9])|{_any(ISSUERS)}[A-Za-z0-9_-]{{10,}}+)"
)
#: A credential word and what may stand between it and its value.
_CUE = rf"(?i)(?<![a-z]){_any(CUES)}s?(?:[_-][a-z0-9_-]{{1,20}})?[\"']?\s{{0,2}}(?::=|=>|[:=]|is )\s{{0,2}}"
CUED = _CUE + r"(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"'<>]{4,})"
#: user:password of an address.
IN_URL = r"(?<=://)[^\s:/@\"']++:[^\s/@\"']{3,}+(?=@)"

FEATURES = ("length", "letter_digit", "case", "distinct", "digits", "vowels", "dictionary", "repeated", "slashes", "path", "cue", "harmless", "prefix", "others", "classes", "consonants", "code")


def _share(m: Column, pattern: str) -> Column:
    """Share of m's characters that the pattern covers."""
    return 1 - F.length(F.regexp_replace(m, pattern, "")) / F.length(m)


def _cuts(m: Column, pattern: str) -> Column:
    """Places in m where the zero-width pattern holds, for each character."""
    return (F.length(F.regexp_replace(m, pattern, "\u0000")) - F.length(m)) / F.length(m)


def features(m: Column, before: Column, after: Column, path: Column) -> Column:
    """array<double> in the order of FEATURES."""
    low = F.lower(m)
    near = F.lower(before)
    distinct = F.size(F.array_distinct(F.split(m, ""))) / F.least(F.length(m), F.lit(40))
    return F.array(
        F.length(m).cast("double"),
        _cuts(m, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        _cuts(m, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        distinct.cast("double"),
        _share(m, "[0-9]"),
        _share(low, "[aeiou]"),
        _share(low, _any(WORDS)),
        _share(low, r"(.)\1{2,}"),
        _share(m, "[/_-]"),
        F.coalesce(F.lower(path).rlike(rf"(?:^|[^a-z]){_any(PATHS)}(?:[^a-z]|$)"), F.lit(False)).cast("double"),
        near.rlike(rf"(?:^|[^a-z]){_any(CUES)}s?(?:[_-][a-z0-9_-]{{1,20}})?[\"']?\s{{0,2}}(?::=|[:=]|is|=>)?\s{{0,2}}[\"']?$|://[^\s:/@]+:$").cast("double"),
        (near.rlike(rf"(?:^|[^a-z0-9]){_any(HARMLESS)}[\"']?\s{{0,2}}[:=#]?\s{{0,2}}[\"']?$") | low.rlike("example|dummy|placeholder|changeme|your|sample")).cast("double"),
        m.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abprs]-|^sk[-_]|^eyJ|^AIza|^-----BEGIN|^glpat-|^npm_").cast("double"),
        _share(m, "[^A-Za-z0-9]"),
        (m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") + m.rlike("[0-9]").cast("int") + m.rlike("[^A-Za-z0-9]").cast("int")).cast("double"),
        _share(low, "[bcdfghjklmnpqrstvwxz]{4,}"),
        m.rlike(r"[$%]\{|\{\{|^<|>$|\(\)?$|\([\w\"']|^[A-Za-z_]+(?:\.[A-Za-z_]+)+[(\[]?|\[[\"'\w]+\]|^\*+$|^[Xx.]+$").cast("double"),
    )


def _candidate_values(text: Column) -> Column:
    """array<struct<m, start, end>> of the candidates, by place; none overlaps another."""
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")
    tokens = F.when(text.rlike(rf"[0-9]|-----BEGIN|A[KS]IA|{_any(ISSUERS)}"), matches(text, TOKENS)).otherwise(none)

    def value(x: Column) -> Column:
        """The value after the credential word, without its quotes or the punctuation after it."""
        body = F.regexp_replace(x["m"], "^" + _CUE, "")
        start = x["end"] - F.length(body)
        quoted = body.rlike("^[\"']")
        inner = F.when(quoted, body.substr(F.lit(2), F.length(body) - 2)).otherwise(F.regexp_replace(body, r"[.,;:!?)\]}]+$", ""))
        start = F.when(quoted, start + 1).otherwise(start)
        return F.struct(inner.alias("m"), start.cast("int").alias("start"), (start + F.length(inner)).cast("int").alias("end"))

    def password(x: Column) -> Column:
        inner = F.regexp_replace(x["m"], "^[^:]*:", "")
        return F.struct(inner.alias("m"), (x["end"] - F.length(inner)).cast("int").alias("start"), x["end"].alias("end"))

    # every credential word has one of these
    low = F.lower(text)
    cue = reduce(Column.__or__, (low.contains(x) for x in ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "aws")))
    cued = F.when(cue, F.transform(matches(text, CUED), value)).otherwise(none)
    urls = F.when(text.contains("://"), F.transform(matches(text, IN_URL), password)).otherwise(none)
    found = F.transform(F.filter(F.concat(tokens, cued, urls), lambda x: F.length(x["m"]) >= 3), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("until"), x["m"].alias("m")))
    zero = F.struct(none.alias("a"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["m"].alias("m"), x["start"].alias("start"), (-x["until"]).alias("end")))
        return F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["a"], one).alias("a"), (-x["until"]).alias("at"))).otherwise(acc)

    # most texts have one kind of candidate at most, whose matches don't overlap
    return F.when(F.size(cued) + F.size(urls) > 0, F.aggregate(F.array_sort(found), zero, step)["a"]).otherwise(tokens)


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before, text after, path, 1 if a secret): one half each, from the rules below."""
    r = random.Random(seed)
    some = lambda chars, a, b=None: "".join(r.choices(chars, k=r.randint(a, b or a)))
    alnum, hexa, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    words = WORDS.split()
    plain = lambda: "".join(r.choices("thandeiros", k=r.randint(2, 8))) + " "
    quote = lambda: r.choice(["", '"', "'"])
    cue = lambda: plain() + r.choice(CUES.split()) + r.choice([" = ", "=", ": ", " "]) + quote()
    harmless = lambda: plain() + r.choice(HARMLESS.split()) + r.choice([" ", ": ", "=", " = "]) + quote()
    free = lambda: plain() + plain()
    natural = lambda: "".join(r.choice(["the", "an", "re", "ou", "en", "in", "ti", "on", "es", "la", "de", "qu", "er", "st", "ma", "lo", "ne", "to"]) for _ in range(r.randint(2, 5)))
    leet = lambda: "".join(r.choice([c, c.upper(), c]) for c in natural().translate(str.maketrans("aeo", r.choice(["430", "@30", "aeo"])))) + r.choice("!#$_-.%") * r.randint(0, 1) + some(string.digits, 1, 4) + r.choice(["", "!", "x", "#"])
    out = []
    while len(out) < n:
        path = r.choice(["src1", "app/config.py", "deploy/env", "src/main.go", "notes.txt"])
        kind = r.randrange(9)
        symbols, lower = "!@#$%^&*-_.", string.ascii_lowercase
        if len(out) % 2 == 0:
            value, before, after = [
                (f"AKIA{some(upper, 16)}", r.choice([cue, free])(), None),
                (r.choice(["ghp_", "xoxb-", "sk-", "AIza", "glpat-"]) + some(alnum, 20, 40), r.choice([cue, free])(), None),
                (some(hexa, 16, 64), cue(), None),
                (some(alnum, 16, 64), cue(), None),
                ("eyJ" + some(alnum + "_-", 40, 120), r.choice([cue, free])(), None),
                (some(alnum + "+/", 24, 88) + r.choice(["", "=", "=="]), cue(), None),
                (leet() if r.random() < 0.6 else some(alnum + symbols, 8, 16), cue(), None),
                (some(r.choice([lower, string.ascii_letters, string.ascii_uppercase]), 18, 40), cue(), None),
                (leet() if r.random() < 0.6 else some(alnum, 6, 20), plain() + r.choice(["postgres", "https", "mongodb", "amqp"]) + "://" + plain().strip() + ":", "@db" + plain()),
            ][kind]
        else:
            path = r.choice([path, "tests/data", "docs/example.md", "vendor/lib"])
            value, before, after = [
                (r.choice(["_", "-", ""]).join(r.choices(words, k=r.randint(3, 5))) + some(string.digits, 1, 4), free(), None),
                (some(hexa, 32, 64), harmless(), None),
                ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice([free, harmless])(), None),
                (r.choice(["your-api-key-here-", "EXAMPLE", "dummy_placeholder_", "sample-token-"]) + some(string.digits, 10, 14), r.choice([cue, free])(), None),
                (r.choice("x0a1*") * r.randint(4, 40), r.choice([cue, free])(), None),
                (r.choice([some(string.digits, 16, 20), f"20{some('012', 2)}-{some('01', 2)}-{some('012', 2)}-{some(string.digits, 8)}", "/".join(r.choices(words, k=4)) + some("0123", 1)]), free(), None),
                (r.choice([natural(), natural().capitalize(), r.choice(words), r.choice(words) + "_" + r.choice(words), " ".join(natural() for _ in range(r.randint(2, 6)))]), cue(), None),
                (r.choice(["${" + natural().upper() + "}", "<" + natural() + ">", "{{ " + natural() + " }}", natural() + "." + natural(), natural() + "." + natural() + "()", "os.environ['" + natural().upper() + "']", "get_" + natural() + "(" + natural() + ")", "$" + natural().upper()]), cue(), None),
                (r.choice([some(string.digits, 1, 6), f"{r.randint(1, 9)}.{r.randint(0, 99)}", "null", "none", "true", "false", "required", "string", "changeme", "optional", "n/a"]), cue(), None),
            ][kind]
        out.append((value, before, " " + plain() if after is None else after, path, 1 - len(out) % 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tree: list, at: int) -> None:
    """Fills a complete tree's places from `at` on: (feature, threshold, value)."""
    tree[at] = (0, 1e300, float(y.mean()) if len(y) else 0.5)
    if depth == 0:
        return
    best = (1e-9, None, None)
    if len(y) > 4 and 0 < y.mean() < 1:
        own = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1])
            if not len(k):
                continue
            left = k + 1
            p, q = ones[k] / left, (ones[-1] - ones[k]) / (len(y) - left)
            gain = own - (left * p * (1 - p) + (len(y) - left) * q * (1 - q)) / len(y)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[k[i]] + v[k[i] + 1]) / 2)
    _, f, t = best
    if f is None:  # everything goes left, to a leaf with this value
        _grow(x, y, rng, depth - 1, tree, 2 * at + 1)
        tree[2 * at + 2] = tree[at]
        if depth > 1:
            _grow(x[:0], y[:0], rng, depth - 1, tree, 2 * at + 2)
        return
    tree[at] = (int(f), float(t), tree[at][2])
    low = x[:, f] <= t
    _grow(x[low], y[low], rng, depth - 1, tree, 2 * at + 1)
    _grow(x[~low], y[~low], rng, depth - 1, tree, 2 * at + 2)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[dict]:
    """Complete trees as lists of features, thresholds and values."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        tree: list = [None] * (2 ** (depth + 1) - 1)
        _grow(x[rows], y[rows], rng, depth, tree, 0)
        f, t, v = zip(*tree, strict=True)
        out.append({"f": f, "t": t, "v": v})
    return out


def probability(values: Column, trees: list[dict], depth: int = DEPTH) -> Column:
    """Mean of the leaves that the values reach."""
    kind = "array<struct<f:array<int>,t:array<double>,v:array<double>>>"
    constant = F.from_json(F.lit(json.dumps(trees)), kind)

    def leaf(tree: Column) -> Column:
        step = lambda at, _: 2 * at + 1 + (F.get(values, F.get(tree["f"], at)) > F.get(tree["t"], at)).cast("int")
        return F.get(tree["v"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))

    return F.aggregate(constant, F.lit(0.0), lambda a, tree: a + leaf(tree)) / len(trees)


def trained(spark: SparkSession, findings: list[tuple] | None = None) -> list[dict]:
    """A forest from labelled findings: (candidate, before, after, path, label)."""
    rows = list(findings or labelled_findings())
    if len(rows) > FINDINGS:  # a sample that doesn't depend on their order
        rows = sorted(rows, key=lambda x: hashlib.sha256(repr(x).encode()).digest())[:FINDINGS]
    table = spark.createDataFrame(rows, "m string, before string, after string, path string, label int")
    got = table.select(features(F.col("m"), F.col("before"), F.col("after"), F.col("path")).alias("x"), "label").collect()
    return forest(np.array([r[0] for r in got]), np.array([r[1] for r in got], float))


def found(spark: SparkSession, docs: DataFrame, findings: list[tuple] | None = None) -> DataFrame:
    """docs with `candidates`: array of (start, end, p) of all candidates, and `secrets`: those accepted."""
    trees = trained(spark, findings)
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")

    def rated(x: Column) -> Column:
        before = text.substr(F.greatest(F.lit(1), x["start"] - 39), F.least(F.lit(40), x["start"]))
        after = text.substr(x["end"] + 1, F.lit(20))
        values = features(x["m"], before, after, path)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), values.alias("values"))

    own = [c for c in docs.columns if c not in ("candidates", "secrets")]
    scan = "scan"
    while scan in docs.columns:
        scan += "_"
    out = docs.select(*own, F.transform(_candidate_values(text), rated).alias(scan))
    out = out.select(*own, F.transform(scan, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), probability(x["values"], trees).alias("p"))).alias("candidates"))
    return out.withColumn("secrets", F.filter("candidates", lambda x: x["p"] >= ACCEPT))


def masked(text: Column, secrets: Column) -> Column:
    """The text with each secret replaced."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["t"], text.substr(a["at"] + 1, x["start"] - a["at"]), F.lit(MASK)).alias("t"), x["end"].alias("at"))
    done = F.aggregate(secrets, start, step)
    return F.when(F.size(secrets) > 0, F.concat(done["t"], text.substr(done["at"] + 1, F.length(text)))).otherwise(text)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    scanned = found(spark, docs)
    return scanned.select(
        "doc_id",
        F.size("candidates").cast("long").alias("n_candidates"),
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("candidates", lambda x: x["p"])), F.lit(0.0)), 6).alias("top_score"),
    )
