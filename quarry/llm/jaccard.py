"""Jaccard self-join of documents on word n-grams, as a blocked sparse product.

Documents of equal n-gram sets form a class, and a class has one row of the
incidence matrix. Entries are ordered by how many rows hold them, rarest first;
then two rows that are similar enough share one of each one's first
n - least overlap + 1 entries, so the product is formed over these blocks of
columns only. In each block all rows are first multiplied with the block's
leader, and those that are not in its component with a second one. Rows that are
linked belong to one component; only pairs across components are formed after
that, by zones of size, as long as sizes and
positions leave room for the least overlap and parities of the sets don't rule
it out.

What remains is multiplied: a leader's row is sent once to each part of its
partners, and their overlaps are accumulated over blocks of columns. A pair is
discarded as soon as its count and what is left of both rows can't reach the
least overlap that their sizes ask for.

Counts of holders only decide the order, and any common order gives the same
links: the commonest ORDERED entries, a bounded number, are sent to the tasks.
Entries are hashes of 64 bits; a class is known by two such hashes of its set
and its size, and has a number of its own from there on.

Defined cases: a text of fewer than n words has its whole sequence as the only
entry; one without words has none and is its own component. Null is empty.
Repeated rows are one class, and so are equal sets of several documents; rows
that share a doc_id but not the text are answered each, as their own class is.
A row without doc_id is answered as its class is, but links no others. Of equal
documents the smallest doc_id names the class and the component (ties). Very
long texts are read whole. An empty table gives an empty result. Other columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .ordering import OPEN, ROWS, only, recurring, rows_of
from .store import scope, written

#: Entries that more rows than this hold are put last; the number of such entries that are sent to tasks.
COMMON, ORDERED = 8, 1 << 18
#: Low bits of a packed size and place.
PLACE_BITS = 28
#: Entries are counted in this part of the hash range, which is enough for all first parts of it.
COUNTED = 0.2

#: Words of 64 bits of a set's parities; two sets differ in as many entries at least as their parities do in bits.
PARITIES = 8
BITS = [f"p{i}" for i in range(PARITIES)]
#: Leaders that a block's rows are compared with, one after another, before pairs are formed across components.
ROUNDS = 2
#: Column blocks over which overlaps are accumulated, as a power of two; partners of a row that are multiplied together.
COLUMN_BITS, PART = 2, 2000
SCAN = "doc_id long, n long, low long, high long, " + ", ".join(f"{b} long" for b in BITS)


def entries(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-gram hashes, ascending, and their n + 1 places."""
    data, offsets = K.utf8(column)
    lower = K.LOWER[data]
    starts, ends, first = K.words(lower, offsets)
    word = K.hashes(lower, starts, ends)
    counts = np.diff(first)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    grams = K.ngram_hash(word, words)
    inside = np.flatnonzero(doc_of_word[words - 1 :] == doc_of_word[: len(doc_of_word) - words + 1]) if len(grams) else np.zeros(0, np.int64)
    value, doc = [grams[inside]], [doc_of_word[inside]]
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            value.append(K.mix(K.ngram_hash(word, n)[first[short]] + np.uint64(n)))
            doc.append(short)
    v, d = np.concatenate(value), np.concatenate(doc)
    order = np.argsort(v)
    order = order[np.argsort(d[order].astype(np.uint16 if len(counts) < 65536 else np.int64), kind="stable")]
    v, d = v[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(counts)))])


def first_part(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first entries of a set of n are looked at."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _pick(values: np.ndarray, at: np.ndarray, take: np.ndarray) -> pa.Array:
    """The first take[i] values of each list."""
    out = np.concatenate([[0], np.cumsum(take)])
    index = np.arange(out[-1]) - np.repeat(out[:-1], take) + np.repeat(at[:-1], take)
    return pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(K.signed(values[index])))


def _signatures(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return K.signed(K.folded(v, np.diff(at))), K.signed(K.folded(K.mix(v ^ np.uint64(0x5DEECE66D)), np.diff(at)))


def _parities(v: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each cell of the hash range, whether a set has an odd number of entries in it, as bits."""
    cell = (v >> np.uint64(40)) % np.uint64(64 * PARITIES)
    out = np.zeros((len(at) - 1, PARITIES), np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_xor.at(out, (doc, (cell >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (cell & np.uint64(63)))
    return [np.ascontiguousarray(out[:, i]).view(np.int64) for i in range(PARITIES)]


def _scanner(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            v, at = entries(batch.column(1), words)
            low, high = _signatures(v, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(low), pa.array(high), *map(pa.array, _parities(v, at))], names=["doc_id", "n", "low", "high", *BITS])

    return run


def _counter(words: int):
    """Entries in the counted part of the hash range, summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            v, _ = entries(batch.column(1), words)
            entry, count = np.unique(v[v < np.uint64(int(COUNTED * 2**64))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(entry)), pa.array(count, pa.int64())], names=["entry", "c"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            v, at = entries(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signatures(v, at)[0]), _pick(v, at, np.diff(at))], names=["doc_id", "low", "entries"])

    return run


def _early(words: int, percent: int, common: np.ndarray, holders: np.ndarray):
    """Rows (entry, set's hash, doc_id, size and place) of each set's first part, rarest entries first. common: hashes, ascending, with their number of holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            v, at = entries(batch.column(1), words)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(v), np.int64)
            if len(common):
                i = np.minimum(np.searchsorted(common, v), len(common) - 1)
                count = np.where(common[i] == v, holders[i], 0)
            if count.any():
                v_order = np.lexsort((v, count, doc))
                sorted_v = v[v_order]
            else:
                sorted_v = v
            place = np.arange(len(v)) - at[:-1][doc]
            keep = place < first_part(n, percent)[doc]
            low, _ = _signatures(v, at)
            doc, place = doc[keep], place[keep]
            yield rows_of(sorted_v[keep], low[doc], batch.column(0).to_numpy(zero_copy_only=False)[doc], n[doc] << PLACE_BITS | place)

    return run


def _least(percent: int, a: str, b: str) -> str:
    """Least overlap of two sets of sizes a and b, in SQL."""
    return f"ceil({percent}D * ({a} + {b}) / {100 + percent}D - 1e-9D)"


def _may_be_near(percent: int, a: str, b: str, n: str, m: str) -> str:
    """Whether parities leave room for enough similarity of sets of n and m entries; a and b: prefixes of their parities."""
    differ = " + ".join(f"bit_count({a}{p} ^ {b}{p})" for p in BITS)
    return f"({differ}) * {100 + percent} <= ({n} + {m}) * {100 - percent}"


def _multiply(percent: int):
    """The similar pairs (a, b) of rows (a, part, kind, b, entries), sorted, where a's own row (kind 0) stands before its partners'."""

    def overlaps(head: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which of the rows, of n entries each, are similar to head."""
        least = -(-percent * (n + len(head)) // (100 + percent))
        of = np.repeat(np.arange(len(n)), n)
        block = (v >> np.uint64(64 - COLUMN_BITS)).astype(np.int64)
        count, left = np.zeros(len(n), np.int64), n.copy()
        alive = np.minimum(n, len(head)) >= least
        edge = np.searchsorted(head >> np.uint64(64 - COLUMN_BITS), np.arange(1, (1 << COLUMN_BITS) + 1))
        for k in range(1 << COLUMN_BITS):
            some = np.flatnonzero((block == k) & alive[of])
            at = np.minimum(np.searchsorted(head, v[some]), len(head) - 1)
            count += np.bincount(of[some][head[at] == v[some]], minlength=len(n))
            left -= np.bincount(of[some], minlength=len(n))
            alive &= count + np.minimum(left, len(head) - edge[k]) >= least
        return alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, kind, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            lists = batch.column(4)
            at = np.asarray(lists.offsets).astype(np.int64)
            v = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at -= at[0]
            first = np.flatnonzero(kind == 0)
            out_a, out_b = [], []
            for x, y in zip([0, *(first + 1).tolist()], [*first.tolist(), batch.num_rows], strict=True):
                if x and kind[x - 1] == 0:
                    head = v[at[x - 1] : at[x]]
                if y > x:
                    ok = overlaps(head, v[at[x] : at[y]], np.diff(at[x : y + 1]))
                    out_a.append(a[x:y][ok])
                    out_b.append(b[x:y][ok])
            head = head.copy()
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


def product(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets(row, entries, ascending as unsigned numbers) are similar enough, by their full overlap."""
    load = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = written(spark, pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PART).cast("long")).alias("part"), "b"), "dealt")
    own = dealt.select("a", "part").distinct().join(sets.select(F.col("row").alias("a"), "entries"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "entries")
    other = dealt.join(sets.select(F.col("row").alias("b"), "entries"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "entries")
    both = own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return written(spark, both.mapInArrow(_multiply(percent), "a long, b long").distinct(), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()


def _labelled(led: DataFrame, label: DataFrame) -> DataFrame:
    """led with the components of row (of) and lead (lead_of); one that is linked with none is its own."""
    own = label.select(F.col("node").alias("row"), F.col("component").alias("of"))
    lead_own = label.select(F.col("node").alias("lead"), F.col("component").alias("lead_of"))
    return led.join(own, "row", "left").join(lead_own, "lead", "left").withColumn("of", F.coalesce("of", "row")).withColumn("lead_of", F.coalesce("lead_of", "lead"))


def linked_blocks(spark: SparkSession, blocks: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of the rows that are similar to another row of one of their blocks, or reachable over such.

    blocks(entry, row, n, place): rows of n entries that share a column, which stands
    at this place of theirs at the latest. known(row, n, weight, parities): of rows
    that may lead a block the heaviest does, as the one with most copies is the one
    that the others were made from. sets_of gives (row, entries) of the rows asked for.
    """
    of = lambda end, q: known.select(F.col("row").alias(end), F.col("n").alias(f"{q}n"), *(F.col(p).alias(f"{q}{p}") for p in BITS))
    weighed = blocks.join(known.select("row", "weight"), "row")
    links, label, first = None, None, None
    for _ in range(ROUNDS):
        # rows that are not in the component of a leader before, with a leader of their own
        leaders = weighed.groupBy("entry").agg(F.min(F.struct("place", (-F.col("weight")).alias("w"), "row", "n")).alias("x")).select("entry", F.col("x.row").alias("lead"), F.col("x.n").alias("lead_n"), F.col("x.place").alias("lead_place"))
        led = weighed.join(leaders, "entry").where("row <> lead")
        room = f"least(n - place, lead_n - lead_place) >= {_least(percent, 'n', 'lead_n')} and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)"
        pairs = led.where(room).select(F.col("lead").alias("a"), F.col("row").alias("b")).distinct()
        pairs = pairs.join(of("a", "a_"), "a").join(of("b", "b_"), "b").where(_may_be_near(percent, "a_", "b_", "a_n", "b_n")).select("a", "b")
        pairs = written(spark, pairs, "pairs")
        found = product(spark, pairs, sets_of(_ends(pairs)), percent)
        links = found if links is None else links.unionByName(found)
        label = components(spark, links)
        first = led if first is None else first
        weighed = written(spark, _labelled(led, label).where("of <> lead_of").select("entry", "row", "n", "place", "weight"), "open")
        if weighed.isEmpty():
            return label

    # across components: rows outside their first leader's component, with all rows of the block but the leader
    placed = written(spark, _labelled(first, label).select("entry", "row", "n", "place", "of", "lead_of"), "placed")
    unsettled = placed.groupBy("entry").agg(F.count("*").alias("c"), F.max((F.col("of") != F.col("lead_of")).cast("int")).alias("open")).where("c > 1 and open = 1").select("entry")
    # similar sets are of one zone of size, or of two next to each other
    zone = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.001 if percent < 100 else 1e-9)).cast("long")
    placed = placed.join(unsettled, "entry", "left_semi").join(known.select("row", *BITS), "row").withColumn("zone", zone)
    placed = written(spark, placed, "placed")
    x = placed.where("of <> lead_of").select("entry", F.explode(F.sequence(F.col("zone") - 1, F.col("zone") + 1)).alias("zone"), *(F.col(c).alias(f"x_{c}") for c in ("row", "n", "place", "of", *BITS)))
    cross = x.join(placed, ["entry", "zone"]).where("of <> x_of and (of = lead_of or row < x_row)")
    cross = cross.where(f"100 * least(n, x_n) >= {percent} * greatest(n, x_n) and least(n - place, x_n - x_place) >= {_least(percent, 'n', 'x_n')}")
    cross = cross.where(_may_be_near(percent, "", "x_", "n", "x_n"))
    cross = written(spark, cross.select(F.least("row", "x_row").alias("a"), F.greatest("row", "x_row").alias("b")).distinct(), "cross")
    if cross.isEmpty():
        return label
    return components(spark, links.unionByName(product(spark, cross, sets_of(_ends(cross)), percent)))


def _common(spark: SparkSession, texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest entries, ORDERED at most, ascending, and their counts."""
    counted = texts.mapInArrow(_counter(words), "entry long, c long").groupBy("entry").agg(F.sum("c").alias("c")).where(f"c > {COMMON}")
    counted = written(spark, counted, "common")
    steps = counted.select(F.floor(F.log2("c") * 4).alias("step"), "entry").groupBy("step").count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for step, n in steps:  # a few hundred at most
        if total + n > ORDERED:
            break
        total, least = total + n, step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counted.where(F.floor(F.log2("c") * 4) >= least).toPandas()
    entry = rows["entry"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(entry)
    return entry[order], rows["c"].to_numpy(np.int64)[order]


def similar(spark: SparkSession, docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of equal sets), component_id.

    Two documents are linked when 100 * common n-grams >= percent * all n-grams of both.
    """
    with scope(spark):  # the result is written, and what was on its way goes
        return written(spark, _similar(spark, docs, words, percent), "similar")


def _similar(spark: SparkSession, docs: DataFrame, words: int, percent: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = written(spark, texts.mapInArrow(_scanner(words), SCAN), "scan")
    classes = scan.where("n > 0").groupBy("low", "high", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"), *(F.first(b).alias(b) for b in BITS))
    classes = written(spark, classes.select(F.monotonically_increasing_id().alias("row"), "*"), "classes")
    common, holders = _common(spark, texts, words)
    early = texts.where("doc_id is not null").mapInArrow(_early(words, percent, common, holders), ROWS)
    shared = recurring(spark, early, "early", OPEN)
    blocks = shared.select(F.col("a").alias("entry"), F.col("b").alias("low"), F.shiftright("at", PLACE_BITS).alias("n"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place")).distinct()
    blocks = written(spark, blocks.join(classes.select("low", "n", "row"), ["low", "n"]).select("entry", "row", "n", "place"), "blocks")

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = written(spark, classes.join(rows, "row").select(F.col("class_id").alias("doc_id"), "low", "row"), "wanted")
        found = only(texts, wanted, "doc_id").mapInArrow(_sets(words), "doc_id long, low long, entries array<long>")
        return written(spark, found.join(wanted, ["doc_id", "low"]).select("row", "entries"), "sets")

    label = linked_blocks(spark, blocks, classes.select("row", "n", "weight", *BITS), sets_of, percent)
    named = classes.join(label, classes["row"] == label["node"], "left").select("low", "n", "high", "class_id", F.coalesce("component", "row").alias("component"))
    first = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(first, "component").drop("component")
    return scan.join(named, ["n", "low", "high"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
