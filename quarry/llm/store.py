"""Written intermediate tables, by which jobs survive the loss of executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import shared_folder

#: Tables that are there, oldest first.
_paths: list[str] = []


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again. The files go with their scope, or when the application ends."""
    path = f"{shared_folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Deletes a table that `written` gave and that nothing reads any more."""
    _drop(spark, table.written_path)
    _paths.remove(table.written_path)


@contextmanager
def scope(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """At its end, of the tables written inside only the last one stays, or none after an error; the one at `keep` from before goes, too."""
    before, done = len(_paths), False
    try:
        yield
        done = True
    finally:
        for path in [*(_paths[before:-1] if done else _paths[before:]), *([keep] if keep in _paths else [])]:
            _drop(spark, path)
            _paths.remove(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that are done: Spark deletes them when the driver's collector finds their plans unused."""
    spark.sparkContext._jvm.System.gc()


def latest() -> str | None:
    return _paths[-1] if _paths else None


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the application is over; a folder that stays does no harm
        pass
