"""Removal of long repeated byte strings by prefix-free parsing.

Every text is parsed into phrases (see `parsing`). The strings of SPAN bytes
that start in a phrase lie in the phrase and its right context; contexts are
put into corpus order by one distributed sort of (trigger, context) hashes, and
equal neighbours show which strings occur elsewhere:

1. a context that recurs as a whole: all its strings do;
2. a trigger that recurs in another context: the phrase is cut into blocks at
   fixed distances from the trigger, and the blocks' contexts are sorted, too;
3. what is common to a block's strings recurs, but not the block: its strings
   are sorted one by one.

The order among unequal strings doesn't matter here, so hashes stand for the
sorted suffixes. Two strings count as equal if two hashes of 64 bits agree,
that of the string and that of a part of it. A sort splits a key of any size
over several tasks; only the first and last row of each task are compared with
those of others.

Defined cases: null is empty; texts shorter than SPAN bytes stay whole;
repeated rows, and rows that share a doc_id, are occurrences of their own, so all
their long strings go; all occurrences of a string are removed alike, so there
are no ties; very long texts are read whole; an empty table gives an empty
result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .parsing import TRIGGER, phrases
from .ordering import ROWS, numbered, recurring, rows_of, with_lists
from .store import scope, written

SPAN = 200
#: Starts in a block of step 2.
BLOCK = 12
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def packed(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    return start << 9 | (last - start)


def _parse(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            data, offsets = K.utf8(batch.column(1))
            s = K.running(data)
            first, last, trigger = phrases(data, offsets, span, s)
            doc = np.searchsorted(offsets, first, "right") - 1
            own = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            yield rows_of(K.span_hash(s, trigger, trigger + TRIGGER), K.span_hash(s, first, last + span), own, packed(first - offsets[doc], last - offsets[doc]))

    return run


def _segments(span: int):
    """The bytes of the phrases that step 2 looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            lists = batch.column(2)
            counts = np.diff(np.asarray(lists.offsets))
            at = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            start, last = at >> 9, (at >> 9) + (at & 511)
            base = np.repeat(offsets[:-1], counts)
            raw = data.tobytes()
            part = [raw[x:y] for x, y in zip((base + start).tolist(), (base + last + span).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(part, pa.binary())], names=["row", "at", "bytes"])

    return run


def _opened(batch: pa.RecordBatch, span: int):
    """Bytes, sums, each segment's place, first and last start in it, and trigger."""
    data, offsets = K.utf8(batch.column(2))
    s = K.running(data)
    first, last, trigger = phrases(data, offsets, span, s)
    at = batch.column(1).to_numpy(zero_copy_only=False)
    # the phrase is whole in its segment, which has no other
    return data, s, offsets[:-1], at >> 9, first, last, trigger, batch.column(0).to_numpy(zero_copy_only=False)


def _blocks(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "bytes"):
            _, s, base, start, first, last, trigger, row = _opened(batch, span)
            low, high = (first - trigger) // BLOCK, (last - trigger) // BLOCK
            each = high - low + 1
            of = np.repeat(np.arange(len(first)), each)
            number = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + low[of]
            p = trigger[of] + number * BLOCK
            x, y = np.maximum(p, first[of]), np.minimum(p + BLOCK - 1, last[of])
            mark = K.mix(K.span_hash(s, trigger, trigger + TRIGGER)[of] + number.astype(np.uint64))
            core = K.mix(K.span_hash(s, p + BLOCK - 1, p + span) ^ mark)
            whole = K.mix(K.span_hash(s, x, y + span) + (x - p).astype(np.uint64))
            shift = start[of] - base[of]
            yield rows_of(core, whole, row[of], packed(x + shift, y + shift))

    return run


def _singles(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "bytes"):
            _, s, base, start, first, last, trigger, row = _opened(batch, span)
            lists = batch.column(3)
            counts = np.diff(np.asarray(lists.offsets))
            at = lists.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(first)), counts)
            each = (at & 511) + 1
            block = np.repeat(np.arange(len(at)), each)
            place = np.arange(len(block)) - np.repeat(np.cumsum(each) - each, each) + (at >> 9)[block]
            of = of[block]
            x = place - start[of] + base[of]
            yield rows_of(K.span_hash(s, trigger, trigger + TRIGGER)[of], K.span_hash(s, x, x + span), row[of], packed(place, place))

    return run


def _remove(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            data, offsets = K.utf8(batch.column(1))
            raw = data.tobytes()
            lists = batch.column(2)
            places = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            at = lists.flatten().to_numpy(zero_copy_only=False)
            out = []
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = at[places[i] : places[i + 1]]
                text = raw[x:y]
                runs: list[list[int]] = []
                if len(own):
                    start = np.sort(own)
                    low, high = start >> 9, (start >> 9) + (start & 511) + span
                    reach = np.maximum.accumulate(high)
                    new = np.ones(len(low), bool)
                    new[1:] = low[1:] > reach[:-1]
                    ends = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
                    runs = list(zip(low[new].tolist(), reach[ends].tolist(), strict=True))
                kept, k = [], 0
                for a, b in runs:
                    kept.append(text[k:a])
                    k = b
                kept.append(text[k:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
            n, gone, spans, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def cover(spark: SparkSession, texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, at): packed ranges of starts of strings of `span` bytes that also start elsewhere, in texts(row, text)."""
    whole = recurring(spark, texts.select("row", "text").mapInArrow(_parse(span), ROWS), "contexts")
    done = [whole.where("done").select("row", "at")]
    open_phrases = written(spark, whole.where("open").select("row", "at").distinct().groupBy("row").agg(F.collect_list("at").alias("at")), "open")
    found, _ = with_lists(texts.select("row", "text"), open_phrases)
    found = found.where("at is not null").select("row", "text", "at")
    segments = written(spark, found.mapInArrow(_segments(span), "row long, at long, bytes binary"), "segments")
    blocks = recurring(spark, segments.mapInArrow(_blocks(span), ROWS), "blocks")
    done.append(blocks.where("done").select("row", "at"))
    open_blocks = blocks.where("open").select("row", F.col("at").alias("block"))
    # a block belongs to the phrase of its document that holds its first start
    inside = F.expr("filter(blocks, x -> shiftright(x, 9) between shiftright(at, 9) and shiftright(at, 9) + (at & 511))")
    asked = segments.join(open_blocks.groupBy("row").agg(F.collect_set("block").alias("blocks")), "row").withColumn("asked", inside).where("size(asked) > 0")
    singles = recurring(spark, asked.select("row", "at", "bytes", "asked").mapInArrow(_singles(span), ROWS), "strings")
    done.append(singles.where("done").select("row", "at"))
    return done[0].unionByName(done[1]).unionByName(done[2])


def remove_repeats(spark: SparkSession, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    texts = numbered(spark, docs)
    with scope(spark):
        ranges = written(spark, cover(spark, texts, span).distinct().groupBy("row").agg(F.collect_list("at").alias("at")), "ranges")
    having, others = with_lists(texts, ranges)
    none = F.array().cast("array<long>")
    out = having.select("doc_id", "text", F.coalesce("at", none).alias("at"))
    if others is not None:
        out = out.unionByName(others.select("doc_id", "text", none.alias("at")))
    return out.mapInArrow(_remove(span), RESULT)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
