"""Best-fit packing by linear grouping.

Pieces are counted by length, so the driver plans on at most `capacity` numbers
whatever the corpus holds. The large lengths are dealt, longest first, into
groups of equal cardinality and rounded up to the group's longest; over these
few sizes configurations are chosen one after another, each the fullest that
the rest allows and used as often as it can be. Then the groups' actual pieces
take their slots, and the small ones go, longest first, where they fit best.
Several numbers of groups are tried, and the plan with the fewest sequences
counts. Sequences of equal content are kept as one run, so a plan has a bounded
number of rows: it is sent to all tasks, where each piece, by its number within
its length, finds its place.

Defined cases: a null or empty text is one piece with the closing id alone;
repeated rows, and rows that share a doc_id or have none, are packed each; pieces
of one length are exchangeable (ties) and go by doc_id and piece; very long texts
are cut into pieces, whole; an empty table gives an empty result; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import slices
from .store import written

CAPACITY = 4096
END_ID = 1
#: Lengths above this part of the capacity are large.
LARGE = 1 / 8
#: Numbers of groups that are tried.
GROUPS = (8, 24, 96)
#: Pieces of one length are numbered in this many lots at least, of this many pieces at most on average.
LOTS, LOT_ROWS = 64, 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Run:
    """Equal sequences: how many, and the lengths in each."""

    times: int
    free: int
    lengths: list[int] = field(default_factory=list)


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size, so that they fill the capacity as far as they can; the largest left is in."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    best: list[int | None] = [None] * (room + 1)  # the size that reached a sum last
    best[0] = -1
    used = [0] * (room + 1)
    for i, (size, n) in enumerate(zip(sizes, left, strict=True)):
        n -= i == first
        if not n or size > room:
            continue
        used = [0] * (room + 1)
        for s in range(size, room + 1):
            if best[s] is None and best[s - size] is not None and used[s - size] < n:
                best[s], used[s] = i, used[s - size] + 1
    at = max(s for s in range(room + 1) if best[s] is not None)
    taken = [0] * len(sizes)
    taken[first] = 1
    while at:
        taken[best[at]] += 1
        at -= sizes[best[at]]
    return taken


def _groups(large: list[tuple[int, int]], k: int) -> list[list[list[int]]]:
    """[length, count] lists of about equal cardinality, longest first."""
    each = -(-sum(n for _, n in large) // k)
    out, room = [[]], each
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append([length, take])
            n, room = n - take, room - take
    return out


def _large(large: list[tuple[int, int]], k: int, capacity: int) -> list[Run]:
    if not large:
        return []
    groups = _groups(large, k)
    sizes, left = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    runs = []
    while any(left):
        taken = _configuration(sizes, left, capacity)
        times = min(n // t for n, t in zip(left, taken, strict=True) if t)
        left = [n - t * times for n, t in zip(left, taken, strict=True)]
        slots = [g for g, t in enumerate(taken) for _ in range(t)]
        while times:  # as long as every slot's next pieces are of one length
            need: dict[int, int] = {}
            for g in slots:
                need[g] = need.get(g, 0) + 1
            m = min(times, *(groups[g][0][1] // t for g, t in need.items()))
            if m:
                lengths = [groups[g][0][0] for g in slots]
                for g, t in need.items():
                    groups[g][0][1] -= m * t
            else:  # one sequence over a change of length
                m, lengths = 1, []
                for g in slots:
                    while not groups[g][0][1]:
                        groups[g].pop(0)
                    lengths.append(groups[g][0][0])
                    groups[g][0][1] -= 1
            for g in need:
                while groups[g] and not groups[g][0][1]:
                    groups[g].pop(0)
            runs.append(Run(m, capacity - sum(lengths), lengths))
            times -= m
    return runs


def _small(runs: list[Run], small: list[tuple[int, int]], capacity: int) -> list[Run]:
    by_free: dict[int, list[Run]] = {}
    done: list[Run] = []
    frees: list[int] = []

    def add(run: Run) -> None:
        if not run.free:
            done.append(run)
        elif run.free in by_free:
            by_free[run.free].append(run)
        else:
            by_free[run.free] = [run]
            insort(frees, run.free)

    for r in runs:
        add(r)
    for length, n in small:
        while n:
            i = bisect_left(frees, length)
            if i == len(frees):
                each = min(n, capacity // length)
                m = n // each
                add(Run(m, capacity - each * length, [length] * each))
                n -= m * each
                continue
            run = by_free[frees[i]].pop()
            if not by_free[frees[i]]:
                del by_free[frees[i]], frees[i]
            each = min(n, run.free // length)
            m = min(run.times, n // each)
            if m < run.times:
                add(Run(run.times - m, run.free, run.lengths))
            add(Run(m, run.free - each * length, run.lengths + [length] * each))
            n -= m * each
    return done + [r for f in frees for r in by_free[f]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[Run]:
    """Runs that hold counts[length] pieces of each length."""
    order = sorted(counts.items(), reverse=True)
    large = [x for x in order if x[0] > capacity * LARGE]
    small = [x for x in order if x[0] <= capacity * LARGE]
    full = [Run(n, 0, [length]) for length, n in large if length == capacity]
    large = [x for x in large if x[0] < capacity]
    tried = (full + _small(_large(large, k, capacity), small, capacity) for k in groups)
    return min(tried, key=lambda runs: sum(r.times for r in runs))


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: number of its first piece, first sequence and offset of each of its slots."""
    out: dict[int, list[list[int]]] = {}
    next_id = 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rows = out.setdefault(length, [[0], [], []])
            rows[0].append(rows[0][-1] + run.times)
            rows[1].append(next_id)
            rows[2].append(offset)
            offset += length
        next_id += run.times
    return {k: tuple(np.array(x, np.int64) for x in v) for k, v in out.items()}


def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import load

        encoder, end = load(path), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, "text", 2_000_000):
            ids = batch.column(0).to_pylist()
            rows = []
            for doc, coded in zip(ids, encoder.encode(batch.column(1)), strict=True):
                coded += end
                step = capacity * 4
                rows += [(doc, k // step, k // 4, min(step, len(coded) - k) // 4, zlib.crc32(coded[k : k + step])) for k in range(0, len(coded), step)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placer(found: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, ids, offsets = found[int(x)]
                slot = np.searchsorted(first, number[at], "right") - 1
                sequence[at] = ids[slot] + number[at] - first[slot]
                offset[at] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def _numbered(pieces: DataFrame, total: int) -> DataFrame:
    """A number from 0 within each length, without bringing a length's pieces together."""
    lots = max(LOTS, -(-total // LOT_ROWS))
    lot: Column = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lots))
    dealt = pieces.withColumn("lot", lot)
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "lot").count().select("length", "lot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(sizes, ["length", "lot"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("number"))


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(path, capacity), PIECES)
    pieces = written(spark, cut, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    found = places(plan(counts, capacity))
    return _numbered(pieces, sum(counts.values())).mapInArrow(_placer(found), PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
