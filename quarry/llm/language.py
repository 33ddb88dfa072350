"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Every text is normalised (lower case, what isn't a letter to a blank); its
1- to 3-grams are hashed to 2**BITS places, weighted by their frequency in the
text and by the inverse document frequency over all training documents. The
weights are learned by follow-the-regularised-leader with elastic-net penalties
on a bounded sample of the labelled rows (about SAMPLE a language); a
temperature is then fitted to other rows. A text's logits are sums over its
n-grams of one small table, which is sent to the tasks.

Training rows are those with a text, a lang and crc32(doc_id) mod 5 other than
0; of these, remainder 1 calibrates.

Defined cases: a null text, and one without a letter, is `und` with score 0; so
is every text if nothing can be learned, as from an empty table. Every language
that a row may be learned from is learned, however rare. Of equal probabilities
(ties) the language first by name counts. Repeated rows, and rows that share a
doc_id, are answered each. Very long texts are read whole. Other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

SIZES = (1, 2, 3)
BITS = 15
#: Rows a language that train, and that calibrate, about.
SAMPLE, CALIBRATE = 500, 200
#: Documents whose n-grams are looked at together.
TOGETHER = 256
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.3, 1.0, 0.02, 0.5
SCALE = 20.0


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its normal form, and whether it is a letter."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    normal = np.where(letter, np.arange(0x110000), 32).astype(np.uint32)
    for i in range(0x530):
        low = chr(i).lower()
        if letter[i] and len(low) == 1:
            normal[i] = ord(low)
    return normal, letter


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all n-grams, by document; n + 1 offsets into them; whether each text has a letter."""
    data, offsets = K.utf8(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(K.STARTS_POINT[data])])[offsets]
    normal, letter = _tables()
    has = np.diff(np.concatenate([[0], np.cumsum(letter[points])])[at]) > 0
    p = normal[points].astype(np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    places, owners = [], []
    for n in SIZES:
        m = len(p) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h + p[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = doc[n - 1 :] == doc[:m]
        places.append((h >> np.uint64(64 - BITS)).astype(np.int32)[inside])
        owners.append(doc[:m][inside])
    if not places:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64), has
    own = np.concatenate(owners)
    order = np.argsort(own.astype(np.uint16 if len(at) < 65536 else np.int64), kind="stable")
    return np.concatenate(places)[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(at) - 1))]), has


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each place, once for each task; place -1 counts the documents. Of each language, the rows that train (-2) and calibrate (-3)."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    sizes: dict[tuple[int, str], int] = {}
    for batch in K.slices(batches, "text"):
        place, at, _ = grams(batch.column(0))
        for a in range(0, batch.num_rows, TOGETHER):
            b = min(a + TOGETHER, batch.num_rows)
            held = np.zeros((b - a, 1 << BITS), bool)
            held[np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), place[at[a] : at[b]]] = True
            total += held.sum(0)
        n += batch.num_rows
        for lang, fold in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key = (-3 if fold == 1 else -2, lang)
            sizes[key] = sizes.get(key, 0) + 1
    some = np.flatnonzero(total)
    kinds = np.append(some, [-1] + [k for k, _ in sizes])
    langs = [None] * (len(some) + 1) + [lang for _, lang in sizes]
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(langs, pa.string()), pa.array(np.append(total[some], [n, *sizes.values()]))], names=["place", "lang", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text"):
        place, at, _ = grams(batch.column(1))
        where, share = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            i, c = np.unique(place[a:b], return_counts=True)
            where.append(i.astype(np.int32))
            share.append((c / max(1, b - a)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(where, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["lang", "fold", "place", "share"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, seed: int = 11) -> np.ndarray:
    """Weights (places + 1, classes), the last row the bias; rows: (class, places, values)."""
    size = 1 << BITS
    z, n, w = (np.zeros((size + 1, classes)) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            logit = x @ wi
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * wi
            n[at] = grown
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    low, high = -3.0, 3.0
    for _ in range(60):  # the loss is convex in 1 / t
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and a table (places + 1, languages) of logits, divided by the temperature."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang", _fold().alias("fold"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("lot")).where("fold <> 0")
    counted = rows.select("text", "lang", F.col("fold").cast("int").alias("fold")).mapInArrow(_holders, "place long, lang string, n long").groupBy("place", "lang").agg(F.sum("n").alias("n")).toPandas()  # places and languages
    sizes = {k: dict(zip(*(counted.loc[counted["place"] == at, c] for c in ("lang", "n")), strict=True)) for k, at in (("a", -2), ("b", -3))}
    names = sorted({*sizes["a"], *sizes["b"]})
    if not names:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    # a language without rows to train on learns from those that calibrate
    only_b = {x for x in names if x not in sizes["a"]}
    part = {x: [int((1 << 20) * min(1.0, most / max(1, sizes[k].get(x, 0)))) for k, most in (("a", SAMPLE), ("b", SAMPLE if x in only_b else CALIBRATE))] for x in names}
    limit = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.array(*map(F.lit, part[x])) for x in names)))
    chosen = F.col("lot") < F.get(F.element_at(limit, F.col("lang")), F.when(F.col("fold") > 1, 0).otherwise(1))
    total = int(counted.loc[counted["place"] == -1, "n"].iloc[0])
    held = np.zeros(1 << BITS)
    held[counted.loc[counted["place"] >= 0, "place"]] = counted.loc[counted["place"] >= 0, "n"]
    idf = (np.log((1 + total) / (1 + held)) + 1) * SCALE
    got = rows.where(chosen).select("lang", "text", F.col("fold").cast("int").alias("fold")).mapInArrow(_vectors, "lang string, fold int, place array<int>, share array<float>").collect()
    number = {x: i for i, x in enumerate(names)}
    vectors = sorted(((number[r[0]], r[1], np.array(r[2], np.int64), np.array(r[3]) * idf[np.array(r[2], np.int64)]) for r in got), key=lambda v: (v[0], v[1], len(v[2]), v[2].tolist()[:20], v[3].tolist()[:20]))
    trains = lambda y, fold: fold != 1 or names[y] in only_b
    w = ftrl([(y, at, x) for y, fold, at, x in vectors if trains(y, fold)], len(names))
    held_back = [(y, x @ w[at] + w[-1]) for y, fold, at, x in vectors if not trains(y, fold)]
    t = temperature(np.array([v for _, v in held_back]), np.array([y for y, _ in held_back], int)) if held_back else 1.0
    table = np.concatenate([w[:-1] * idf[:, None], w[-1:]]) / t
    return names, table.astype(np.float32)


def _predictor(names: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            place, at, has = grams(batch.column(1))
            n = batch.num_rows
            if names:
                sums = np.zeros((n, len(names)))
                for c in range(len(names)):
                    run_ = np.concatenate([[0.0], np.cumsum(table[:, c][place], dtype=np.float64)])
                    sums[:, c] = np.diff(run_[at])
                logit = sums / np.maximum(np.diff(at), 1)[:, None] + table[-1]
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best, score = p.argmax(1), p.max(1)
            else:
                has, best, score = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
            said = [names[i] if ok else "und" for i, ok in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(np.where(has, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score; only the text is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predictor(names, table), "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, *train(docs)).select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
