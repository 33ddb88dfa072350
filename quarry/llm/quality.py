"""Quality rules: counts within a text, and line frequency across documents.

Lines are normalised (A-Z to lower case, every digit to 0, white space to one
blank) and hashed; the documents that hold a line are counted per host. A line
in more documents than the host's limit is frequent. A frequent line is removed
if most of the documents that hold it consist mainly of other text; this tells
boilerplate from the lines of a document with many copies, which are for
deduplication. A document that loses more than DEPLETED of its words to removed
lines is rejected. So are those that fail the base rules.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows, and rows that share a doc_id, count as documents
of their own; a line or a loss at just the limit (ties) is frequent, and not
depleted; very long texts are read whole; an empty table gives an empty result;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .store import written

#: A line is frequent in a host from this many documents, and this part of the host's documents, on; of a large host it never takes more than MOST_DOCS.
LEAST_DOCS, LEAST_PART, MOST_DOCS = 30, 0.005, 1000
#: A document consists mainly of frequent lines beyond this part of its words.
MAINLY = 0.5
#: Part of the holding documents that must consist mainly of other text.
AMONG_OTHERS = 0.5
#: A document is rejected when it loses more than this part of its words.
DEPLETED = 0.5

_NORMAL = K.LOWER.copy()
_NORMAL[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCAN = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to another, equal to an earlier one) for each key."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    other, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    other[order[1:][same]] = True
    earlier[order[1:][same]] = True
    other[order[:-1][same]] = True
    return other, earlier


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and its distinct normalised lines: `line` (hash), `line_words` (in all its occurrences), `line_at` (n + 1 places)."""
    data, offsets = K.utf8(column)
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    doc_of_word = np.repeat(np.arange(n), np.diff(first))
    # 3-word windows
    repeated = np.zeros(len(starts), bool)
    grams = K.ngram_hash(K.hashes(data, starts, ends), 3)
    if len(grams):
        inside = np.flatnonzero(doc_of_word[2:] == doc_of_word[:-2])
        again, _ = _repeats(K.mix(grams[inside] + doc_of_word[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        for i in range(3):
            repeated[inside[again] + i] = True
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    doc_of_line = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[doc_of_line + 1])
    line_end -= (data[np.maximum(line_end - 1, 0)] == 10) & (line_end > line_start)
    a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    has = b > a
    line_start, line_end, doc_of_line, a, b = line_start[has], line_end[has], doc_of_line[has], a[has], b[has]
    own = doc_of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, copied = _repeats(K.mix(K.hashes(data, line_start, line_end) + own))
    normal = K.folded(*K.runs(K.hashes(_NORMAL[data], starts, ends), a, b))
    key = K.mix(normal + own)
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(doc_of_line[at], kind="stable")
    weight = np.bincount(back, b - a, len(at)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    return {
        "n_words": np.diff(first),
        "word_chars": _sums(K.STARTS_POINT[data] & ~K.IS_SPACE[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc_of_line[copied], minlength=n),
        "n_repeat_words": np.bincount(doc_of_word[repeated], minlength=n),
        "line": K.signed(normal[at[order]]),
        "line_words": weight[order],
        "line_at": np.concatenate([[0], np.cumsum(np.bincount(doc_of_line[at], minlength=n))]),
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    names = [f.split()[0] for f in SCAN.split(", ")]
    for batch in K.slices(batches, "text"):
        m = measure(batch.column(batch.schema.get_field_index("text")))
        n = batch.num_rows
        at = pa.array(m["line_at"], pa.int32())
        counts = [pa.array(m[c], pa.int64()) for c in names[3:8]]
        lists = [pa.ListArray.from_arrays(at, pa.array(m["line"], pa.int64())), pa.ListArray.from_arrays(at, pa.array(m["line_words"], pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), *counts, *lists], names=names)
        row += n


def rated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, removed_words, base_failed, kept."""
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text").mapInArrow(_scan, SCAN)
    scan = written(spark, scanned, "quality")
    lines = scan.select("row", "host", "n_words", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", "n_words", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hosts = scan.groupBy("host").agg(F.count("*").alias("docs"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("holders")).where(F.col("holders") >= LEAST_DOCS)
    frequent = counted.join(hosts, "host").where(F.col("holders") >= F.least(F.col("docs") * LEAST_PART, F.lit(float(MOST_DOCS)))).select("host", "line", "holders")
    found = written(spark, lines.join(frequent, ["host", "line"]), "lines")
    mainly = found.groupBy("row").agg((F.sum("words") <= F.first("n_words") * MAINLY).alias("other"))
    removed = (
        found.join(mainly, "row")
        .groupBy("host", "line")
        .agg(F.sum(F.col("other").cast("long")).alias("among"), F.first("holders").alias("holders"))
        .where((F.col("among") >= LEAST_DOCS) & (F.col("among") >= F.col("holders") * AMONG_OTHERS))
        .select("host", "line")
    )
    lost = found.join(removed, ["host", "line"]).groupBy("row").agg(F.sum("words").cast("long").alias("removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        scan.drop("lines", "line_words")
        .join(lost, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("removed_words") <= F.col("n_words") * DEPLETED))
        .drop("row", "host")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
