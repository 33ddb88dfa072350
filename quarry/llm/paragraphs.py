"""Removal of repeated paragraphs by MinHash banding.

A paragraph is a line; all lines are compared, whole. So that a passage inside
longer lines is found too, the pieces of a line are compared as well: its
sentences, where short ones are joined, and those of over LONG words are cut at
words whose hash is the least among their neighbours, so that equal passages
are cut alike wherever they stand. A piece of less than LEAST words belongs to
the one beside it, so every word of a line is in one of its pieces.

Lines and pieces have one MinHash value a band (ROWS_A_BAND of them), and so many
bands that of the pairs with a similarity of 0.8 at least RECALL collide in one;
units of fewer shingles than EXACT are only similar when equal. Equal units, by
two hashes of 64 bits, are one class, counted before any exchange. The classes
that collide in a band are a block; its pairs are verified by their exact
Jaccard similarity (see `jaccard.linked_blocks`) and clustered by components.
Lines are compared with lines and pieces with pieces (a line always collides
with one of its own); a line of one piece is both. The first line of a cluster,
by doc_id and place, stays; the others are removed. Then the same is done with
the pieces of the lines that stay, so that what is removed always has a copy
that stays.

Defined cases: a null or empty text has no paragraphs. Repeated rows, and rows
that share a doc_id but not the text, are documents of their own: the first, by
doc_id and then by text (ties), keeps what the others lose. A row without doc_id
keeps all and takes nothing from others. Very long texts are read whole. An
empty table gives an empty result. Other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import jaccard as J
from .ordering import numbered, only, with_lists
from .store import release, scope, written

WORDS, PERCENT = 5, 80
LEAST, LONG, NEAR = 8, 32, 8
#: Of the pairs with a similarity of PERCENT / 100 this part collides in a band, at least.
RECALL, ROWS_A_BAND = 0.995, 1
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - (PERCENT / 100) ** ROWS_A_BAND))
#: A set of k entries and a similar one that isn't equal: one has k * 100 / PERCENT entries or more, so k is 4 at least.
EXACT = math.ceil(PERCENT / (100 - PERCENT))
#: A unit's place: its line's number, its number among the line's pieces (0: the whole line), and a bit that is 0 for a line and 1 for a piece.
LINE_BITS = 32
IS_LINE, IS_PIECE = "at & 1 = 0", "at & 1 = 1"
_LINES = np.uint64(0x6C8E9CF570932BD5)

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_SEEDS = K.mix(np.arange(1, BANDS * ROWS_A_BAND + 1, dtype=np.uint64))


def _breaks(lower: np.ndarray, offsets: np.ndarray):
    """Word hashes, starts and ends, and whether each word is the first of a line, and of a sentence."""
    starts, ends, first = K.words(lower, offsets)
    n = len(starts)
    word = K.hashes(lower, starts, ends)
    line = np.zeros(n, bool)
    if not n:
        return word, starts, ends, line, line
    line[0] = True
    line[first[:-1][first[:-1] < n]] = True
    lines = np.concatenate([[0], np.cumsum(lower == 10)])
    line[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    new = line.copy()
    new[1:] |= _ENDS[lower[ends[:-1] - 1]]
    return word, starts, ends, line, new


def _chopped(word: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new, with the cuts of what is longer than LONG words."""
    n = len(word)
    size = np.diff(np.append(np.flatnonzero(new), n))
    if not (size > LONG).any():
        return new
    # neighbours of the same paragraph only: what stands around it must not count
    unit = np.cumsum(new)
    place = np.arange(n) + NEAR * unit
    wide = np.full(n + NEAR * (unit[-1] + 2), np.iinfo(np.uint64).max, np.uint64)
    value = K.mix(word)
    wide[place] = value
    least = np.lib.stride_tricks.sliding_window_view(wide, 2 * NEAR + 1).min(axis=1)[place - NEAR]
    return new | np.repeat(size > LONG, size) & (value == least)


def cut(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, starts and ends, and the first word of each sentence or part of a long one (one more at the end), over all documents."""
    word, starts, ends, _, new = _breaks(K.LOWER[data], offsets)
    return word, starts, ends, np.append(np.flatnonzero(_chopped(word, new)), len(word))


def _pieces(word: np.ndarray, line: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The first word of each line's pieces. line, new: the first words of lines, and of sentences."""
    n = len(word)
    at = np.flatnonzero(new)
    short = np.diff(np.append(at, n)) < LEAST
    joined = np.zeros(len(at), bool)
    joined[1:] = short[1:] & short[:-1] & ~line[at[1:]]
    new = new.copy()
    new[at[joined]] = False  # short sentences in a row are one
    new = _chopped(word, new)
    at = np.flatnonzero(new)
    short = np.diff(np.append(at, n)) < LEAST
    opens = line[at]
    back = short & ~opens  # to the piece before
    back[1:] |= short[:-1] & opens[:-1] & ~opens[1:]  # a line's short head: to the piece after
    return at[~back]


def units(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, starts and ends; and each unit's document, first word, end and place, in order of document and place."""
    word, starts, ends, line, new = _breaks(K.LOWER[data], offsets)
    n = len(word)
    none = np.zeros(0, np.int64)
    if not n:
        return word, starts, ends, none, none, none, none
    heads = np.flatnonzero(line)
    piece = _pieces(word, line, new)
    of = np.searchsorted(heads, piece, "right") - 1  # the piece's line
    begin = np.searchsorted(of, np.arange(len(heads)))
    count = np.diff(np.append(begin, len(piece)))
    doc = np.searchsorted(offsets, starts[heads], "right") - 1
    number = np.arange(len(heads)) - np.searchsorted(doc, doc)
    part = np.where(count[of] > 1, np.arange(len(piece)) - begin[of] + 1, 0)
    a = np.concatenate([heads, piece])
    b = np.concatenate([np.append(heads[1:], n), np.append(piece[1:], n)])
    at = np.concatenate([number << LINE_BITS, number[of] << LINE_BITS | part << 1 | 1])
    owner = np.concatenate([doc, doc[of]])
    order = np.lexsort((at, owner))
    return word, starts, ends, owner[order], a[order], b[order], at[order]


UNITS = "doc long, row long, at long, low long, high long, n long, " + ", ".join(f"b{j} long" for j in range(BANDS))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit's two hashes, number of shingles and band values; those of units that are only similar when equal are null."""
    for batch in K.slices(batches, "text"):
        data, offsets = K.utf8(batch.column(2))
        word, _, _, doc, a, b, at = units(data, offsets)
        if not len(a):
            continue
        values, counts = K.runs(word, a, b)
        salt = np.where(at & 1 == 0, _LINES, np.uint64(0))
        low = K.mix(K.folded(values, counts) ^ salt)
        high = K.mix(K.folded(K.mix(values ^ np.uint64(0x5DEECE66D)), counts) + salt)
        n = b - a - WORDS + 1
        grams = K.ngram_hash(word, WORDS)
        use = np.flatnonzero(n >= EXACT)
        span = np.stack([a[use], a[use] + n[use]], 1).ravel()
        bands = []
        for j in range(BANDS):
            band = np.full(len(use), j, np.uint64)
            for i in range(ROWS_A_BAND):
                value = np.append(K.mix(grams ^ _SEEDS[j * ROWS_A_BAND + i]), np.iinfo(np.uint64).max)
                band = K.mix(band + np.minimum.reduceat(value, span)[::2]) if len(use) else band
            every = np.zeros(len(a), np.uint64)
            every[use] = K.mix(band ^ salt[use])
            bands.append(pa.array(K.signed(every), mask=n < EXACT))
        ids = [pa.array(batch.column(i).to_numpy(zero_copy_only=False)[doc]) for i in (0, 1)]
        columns = [*ids, pa.array(at), pa.array(K.signed(low)), pa.array(K.signed(high)), pa.array(np.maximum(n, 1)), *bands]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in UNITS.split(", ")])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of shingles, and their parities, of the listed units."""
    for batch in K.slices(batches, "text"):
        data, offsets = K.utf8(batch.column(1))
        _, starts, ends, doc, a, b, at = units(data, offsets)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        raw = data.tobytes()
        lists = batch.column(2)
        counts = np.diff(np.asarray(lists.offsets))
        asked = lists.flatten()
        place = asked.field("place").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        found = [int(first[d] + np.searchsorted(at[first[d] : first[d + 1]], x)) for d, x in zip(owner.tolist(), place.tolist(), strict=True)]
        texts = pa.array([raw[starts[a[k]] : ends[b[k] - 1]] for k in found], pa.binary()).cast(pa.string())
        v, to = J.entries(texts, WORDS)
        lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(K.signed(v)))
        yield pa.RecordBatch.from_arrays([asked.field("class").cast(pa.int64()), pa.array(np.diff(to), pa.int64()), lists, *map(pa.array, J._parities(v, to))], names=["row", "n", "entries", *J.BITS])


def clusters(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(doc, row, at, cluster): units that are in a cluster with others, of texts(row, doc_id, text)."""
    texts = texts.where("doc_id is not null")
    found = written(spark, texts.select(F.col("doc_id").alias("doc"), "row", "text").mapInArrow(_units, UNITS), "units")
    equal = written(spark, found.groupBy("low", "high").agg(F.count("*").alias("c")).where("c > 1"), "equal")
    bands = found.select("low", "high", F.explode(F.array(*(f"b{j}" for j in range(BANDS)))).alias("entry")).where("entry is not null")
    # unlike units in one band: the least and the greatest of half their hash differ; copies are combined before the exchange
    half = F.col("low").bitwiseAND(0xFFFFFFFF)
    open_ = written(spark, bands.groupBy("entry").agg(F.min(half).alias("x"), F.max(half).alias("y")).where("x <> y").select("entry"), "open")
    release(spark)
    blocks = written(spark, only(bands, open_, "entry").distinct(), "colliding")
    classes = written(spark, equal.select("low", "high").unionByName(blocks.select("low", "high")).distinct(), "named")
    classes = written(spark, classes.select(F.monotonically_increasing_id().alias("class"), "low", "high"), "classes")
    blocks = written(spark, blocks.join(classes, ["low", "high"]).select("entry", F.col("class").alias("row")), "blocks")
    near = blocks.select(F.col("row").alias("class")).distinct().join(classes, "class")
    # one unit of each class that collides; its place and row are in the smallest pair
    asked = found.select("row", "at", "low", "high").join(near, ["low", "high"]).groupBy("class").agg(F.min(F.struct("row", "at")).alias("x"))
    lists = written(spark, asked.groupBy(F.col("x.row").alias("row")).agg(F.collect_list(F.struct(F.col("x.at").alias("place"), "class")).alias("at")), "asked")
    having, _ = with_lists(texts.select("row", "text"), lists)
    kind = "row long, n long, entries array<long>, " + ", ".join(f"{b} long" for b in J.BITS)
    sets = written(spark, having.where("at is not null").select("row", "text", "at").mapInArrow(_parts, kind), "sets")
    weights = equal.join(classes, ["low", "high"]).select(F.col("class").alias("row"), F.col("c").alias("weight"))
    known = written(spark, sets.drop("entries").join(weights, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(1))), "known")
    blocks = written(spark, blocks.join(known.select("row", "n"), "row").select("entry", "row", "n", F.lit(0).alias("place")), "blocks")
    label = J.linked_blocks(spark, blocks, known, lambda rows: sets, PERCENT)
    named = classes.join(label, F.col("class") == F.col("node"), "left").select("low", "high", F.coalesce("component", "class").alias("cluster"))
    of_several = named.join(equal, ["low", "high"], "left").groupBy("cluster").agg(F.sum(F.coalesce("c", F.lit(1))).alias("c")).where("c > 1").select("cluster")
    named = written(spark, named.join(of_several, "cluster", "left_semi"), "clustered")
    release(spark)
    return found.select("doc", "row", "at", "low", "high").join(named, ["low", "high"]).select("doc", "row", "at", "cluster")


def _headed(member: DataFrame) -> DataFrame:
    """row, at, head (row, place and document of the cluster's first) of the members of clusters of several."""
    heads = member.groupBy("cluster").agg(F.min(F.struct("row", "at", "doc")).alias("head"), F.count("*").alias("c")).where("c > 1").select("cluster", "head")
    return member.join(heads, "cluster").select("row", "at", "head")


def repeated(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Of texts(row, doc_id, text): row, members (lines and pieces that are in a cluster with others), removed (places, ascending), first_ids (documents whose paragraphs stay instead of or as its own, if in clusters)."""
    member = written(spark, clusters(spark, texts), "clusters")
    gone = (F.col("row") != F.col("head.row")) | (F.col("at") != F.col("head.at"))
    lines = written(spark, _headed(member.where(IS_LINE)).withColumn("gone", gone), "line-heads")
    line = F.shiftright("at", LINE_BITS).alias("line")
    without = lines.where("gone").select("row", line).distinct()
    pieces = _headed(member.where(IS_PIECE).withColumn("line", line).join(without, ["row", "line"], "left_anti")).withColumn("gone", gone)
    return lines.unionByName(pieces).groupBy("row").agg(
        F.size(F.collect_set(F.shiftright("at", 1))).alias("members"),
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("at")))).alias("removed"),
        F.array_sort(F.collect_set("head.doc")).alias("first_ids"),
    )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text"):
        data, offsets = K.utf8(batch.column(1))
        _, starts, ends, doc, a, b, at = units(data, offsets)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        distinct = np.concatenate([[0], np.cumsum(at & ((1 << LINE_BITS) - 1) != 1)])  # a line of one piece counts once
        raw, out = data.tobytes(), []
        for i, gone in enumerate(batch.column(2).to_pylist()):
            kept, k = [], int(offsets[i])
            for g in gone or ():
                j = first[i] + np.searchsorted(at[first[i] : first[i + 1]], g)
                kept.append(raw[k : starts[a[j]]])
                k = int(ends[b[j] - 1])
            kept.append(raw[k : offsets[i + 1]])
            out.append((int(distinct[first[i + 1]] - distinct[first[i]]), b"".join(kept)))
        n, kept = zip(*out, strict=True)
        columns = [batch.column(0), pa.array(n, pa.int64()), batch.column(3), pc.list_value_length(batch.column(2)).cast(pa.int64()), batch.column(4), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_paragraphs", "n_repeated", "n_removed", "first_ids", "kept_text"])


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_repeated, n_removed, first_ids, kept_text of each document."""
    texts = numbered(spark, docs)
    with scope(spark):
        found = written(spark, repeated(spark, texts).select("row", F.col("removed").alias("at"), "members", "first_ids"), "repeated")
    having, others = with_lists(texts, found)
    none = F.array().cast("array<long>")
    columns = ["doc_id", "text", F.coalesce("at", none).alias("at"), F.coalesce("members", F.lit(0)).cast("long").alias("members"), F.coalesce("first_ids", none).alias("first_ids")]
    rows = having.select(columns)
    if others is not None:
        rows = rows.unionByName(others.select("doc_id", "text", none.alias("at"), F.lit(0).cast("long").alias("members"), none.alias("first_ids")))
    return rows.mapInArrow(_removed, "doc_id long, n_paragraphs long, n_repeated long, n_removed long, first_ids array<long>, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
