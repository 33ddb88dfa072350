"""Records that arrive as files of JSON lines, analysed as they come.

Analysis looks at one record at a time, so it needs no state and no watermark;
each trigger appends tokens. Ids must be unique over the stream. The index is
built from the appended tokens in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import field_tokens, tokens_long
from ..sources.records import RECORD


def records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of records with their seq, from JSON lines."""
    return spark.readStream.schema(f"seq bigint, {RECORD}").option("maxFilesPerTrigger", files_per_trigger).json(path)


def tokens(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return tokens_long(field_tokens(records(spark, path, files_per_trigger), unique_ids=True))


def start(spark: SparkSession, source: str, target: str, state: str) -> StreamingQuery:
    """Appends tokens to Parquet at target, each file's exactly once; stops when what is there is done."""
    return tokens(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
