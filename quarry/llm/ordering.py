"""Equal neighbours in one distributed sort.

Rows (a, b, row, at) are put in order by ranges, so that a key of any size is
spread over several tasks, and each is compared with its neighbours. Only the
first and last row of each task are compared with those of other tasks. The rows
are written first: ranges are found by a sample, which else would have the
texts read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, written

DONE, OPEN = 2, 1
#: Keys of documents that are sent to all tasks at most (8 bytes each), to tell which texts need no exchange; with more, all texts are exchanged.
SENT_KEYS = 1 << 21

ROWS = "a long, b long, row long, at long"
FLAGGED = "a long, b long, row long, at long, same int, edge int"


def rows_of(a, b, row, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64)) for x in (a, b, row, at)], names=["a", "b", "row", "at"])


def _compare(wanted: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: same has 2 if a neighbour has the same (a, b), and 1 if one has the same a with another b. Keeps those with a wanted bit, and a task's first and last row (edge = 1)."""

    def flagged(c: list[np.ndarray], before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        a, b = c[0], c[1]
        n = len(a)
        both, only = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # at i: of row i - 1 and row i
        equal = a[1:] == a[:-1]
        both[1:-1] = equal & (b[1:] == b[:-1])
        only[1:-1] = equal & (b[1:] != b[:-1])
        for i, x in ((0, before), (n, after)):
            if x:
                k = min(i, n - 1)
                both[i], only[i] = x == (a[k], b[k]), x[0] == a[k] and x[1] != b[k]
        same = (both[1:] | both[:-1]) * np.int32(2) + (only[1:] | only[:-1])
        edge = np.zeros(n, np.int32)
        edge[0] = before is None
        edge[-1] |= after is None
        keep = (same & wanted > 0) | (edge > 0)
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in c), pa.array(same[keep].astype(np.int32)), pa.array(edge[keep])], names=["a", "b", "row", "at", "same", "edge"])

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held is not None:
            yield flagged(held, before, (c[0][0], c[1][0]))
            before = (held[0][-1], held[1][-1])
        held = c
    if held is not None:
        yield flagged(held, before, None)


def recurring(spark: SparkSession, rows: DataFrame, name: str, wanted: int = DONE | OPEN) -> DataFrame:
    """(a, b, row, at, done, open) of the rows of which a recurs.

    done: a and b recur. open: a recurs with another b, too, and the row is at the
    border of its equals in the order, so that each kind of equals has one open row.
    """
    rows = written(spark, rows, f"{name}-rows")
    order = rows.repartitionByRange("a", "b", "row", "at").sortWithinPartitions("a", "b")
    found = written(spark, order.mapInArrow(partial(_compare, wanted), FLAGGED), name)
    drop(spark, rows)
    edges = found.where("edge = 1")  # two rows of each task
    by_a = edges.groupBy("a").agg(F.count("*").alias("of_a"))
    by_ab = edges.groupBy("a", "b").agg(F.count("*").alias("of_ab"))
    across = F.when(F.col("of_ab") > 1, 2).otherwise(0).bitwiseOR(F.when(F.col("of_a") > F.col("of_ab"), 1).otherwise(0))
    known = edges.join(by_a, "a").join(by_ab, ["a", "b"]).select("a", "b", "row", "at", F.col("same").bitwiseOR(across).alias("same"))
    both = found.where("edge = 0").select("a", "b", "row", "at", "same").unionByName(known.where(F.col("same").bitwiseAND(wanted) > 0))
    return both.select("a", "b", "row", "at", (F.col("same") >= 2).alias("done"), (F.col("same") % 2 == 1).alias("open"))


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is doc_id where that tells all rows apart, else a number in the order of doc_id (null first) and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if texts.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty():
        return texts.select(F.col("doc_id").alias("row"), "doc_id", "text")
    ordered = texts.withColumn("key", F.xxhash64("text")).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "text")
    return written(spark, ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def only(texts: DataFrame, keys: DataFrame, key: str = "row") -> DataFrame:
    """The texts that have one of the keys."""
    keys = keys.select(key).distinct()
    return texts.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, key, "left_semi")


def with_lists(texts: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """texts with their list `at`, and the texts that have none, if few enough have one to send the keys out."""
    keys = lists.select("row")
    if lists.count() > SENT_KEYS:
        return texts.join(lists, "row", "left"), None
    return texts.join(F.broadcast(keys), "row", "left_semi").join(lists.hint("merge"), "row"), texts.join(F.broadcast(keys), "row", "left_anti")
