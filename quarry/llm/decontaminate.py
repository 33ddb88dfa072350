"""Benchmark decontamination with one Aho-Corasick automaton.

The words of a text are the maximal runs of ASCII letters and digits and of
non-ASCII characters, lower-cased in A-Z. Every run of `window` words of a
benchmark item (all its words, if it has fewer) is a key of the automaton. A
text is scanned once, as its words with one blank between; a match's end gives
the number of its last word, and that the place in the original.

Defined cases: a null or empty text, and one without words, is clean. An item
without words is never found. Repeated items and windows each count for their
own item; items without an id count as one, named null. An empty benchmark
leaves all documents clean. There is one result for each row of the documents,
also for rows that repeat a doc_id or have none. Items are listed by their id as
text, each once (ties). Very long texts are scanned whole. Other columns of both
tables, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import slices
from .store import written

WINDOW = 10
#: Bytes of benchmark text in one automaton (about 60 times as much memory).
#: A larger benchmark is scanned in blocks of items, one after another, of which
#: neither the driver nor a task ever holds two.
BLOCK_BYTES = 4_000_000

_TABLE = bytes(
    c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)
)
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, runs array<struct<first:int,last:int,start:int,end:int>>"


def _nulls_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def automaton(items: list[tuple[str | None, str | None]], window: int):
    """None if no item has words. A key's value: (words in the key, the items that have it)."""
    import ahocorasick

    owners: dict[bytes, set[str | None]] = defaultdict(set)
    for item, text in items:
        for key in windows(normal_words(text), window):
            owners[key].add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for key, who in owners.items():
        found.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, tuple(sorted(who, key=_nulls_last))))
    found.make_automaton()
    return found


def word_ends(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words in the original text."""
    kept = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(kept) + 2, np.int8)
    inside[1:-1] = np.frombuffer(_TABLE, np.uint8)[kept] != 32
    edge = np.diff(inside)
    point = np.concatenate([[0], np.cumsum((kept & 0xC0) != 0x80)])
    return list(zip(point[np.flatnonzero(edge == 1)].tolist(), point[np.flatnonzero(edge == -1)].tolist(), strict=True))


def scan(text: str | None, found) -> tuple[int, list[tuple[int, int]], set[str | None]]:
    """Number of words, the maximal hit runs of words (end exclusive), the items."""
    words = normal_words(text)
    if found is None or not words:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    runs: list[list[int]] = []
    items: set[str | None] = set()
    blanks = None
    for end, (n, who) in found.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        stop = int(np.searchsorted(blanks, end))
        items.update(who)
        start = stop - n
        while runs and start <= runs[-1][1]:  # matches come by their ends; a longer one may reach back over runs
            start = min(start, runs[-1][0])
            runs.pop()
        runs.append([start, stop])
    return len(words), [(a, b) for a, b in runs], items


def overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), runs: hit runs of words, as word numbers and as character offsets of the original text.

    The benchmark is the only thing sent out. Its size is measured first; above
    block_bytes it is dealt into blocks by item. Each block is collected, scanned
    for and forgotten before the next; only rows that it hits are written, by their
    number, and the hits of a row are merged in the end.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    if n == 1:
        return narrow.mapInArrow(_scanner([tuple(r) for r in known.collect()], window), RESULT)
    # written, so that a row has the same number in every pass
    narrow = written(spark, narrow.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = []
    for k in range(n):
        block = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        scanned = narrow.mapInArrow(_scanner([tuple(r) for r in block.collect()], window), f"{RESULT}, row long")
        found.append(written(spark, scanned.where("n_hit > 0").select("row", "items", "runs"), "hits"))
    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"]))).alias("n"), F.greatest(a["end"], x["last"]).alias("end"))
    merged = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), runs.alias("runs"))
    merged = merged.select("row", F.aggregate("runs", start, add)["n"].alias("n_hit"), "items", "runs")
    counted = narrow.mapInArrow(_scanner([], window), f"{RESULT}, row long").select("row", "doc_id", "n_words", F.col("items").alias("none"), F.col("runs").alias("no_runs"))
    return counted.join(merged, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", "none").alias("items"), F.coalesce("runs", "no_runs").alias("runs"))


def _scanner(items: list[tuple[str | None, str | None]], window: int):
    fields = ("first", "last", "start", "end")
    run_type = pa.list_(pa.struct([(f, pa.int32()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items, window)
        for batch in slices(batches, "text"):
            total, hit, who, runs = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                n, own, names = scan(text, found)
                at = word_ends(text) if own else []
                total.append(n)
                hit.append(sum(b - a for a, b in own))
                who.append(sorted(names, key=_nulls_last))
                runs.append([dict(zip(fields, (a, b, at[a][0], at[b - 1][1]), strict=True)) for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(who, pa.list_(pa.string())), pa.array(runs, run_type), *batch.columns[2:]],
                names=["doc_id", "n_words", "n_hit", "items", "runs", *batch.schema.names[2:]],
            )

    return run


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlap(spark, docs, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
