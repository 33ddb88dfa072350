"""Indexes kept for the length of an application: built once from a table, searched many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .records import read_index

#: (application, table, its files' state) -> folder.
_built: dict[tuple[str, str, tuple], str] = {}


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for written tables; one of this machine only if all runs here."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="quarry-index-")
    return shared_folder.own


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    where, system = _hadoop(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (system.listStatus(where))))


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where, system = _hadoop(spark, path)
        system.delete(where, True)
    except Exception:  # noqa: BLE001  the application is over; a folder that stays does no harm
        pass


def stored_index(spark: SparkSession, table: str, build: Callable[[SparkSession, str], None]) -> dict[str, DataFrame]:
    """The index of a table: build(spark, folder) writes it where this application has none of these files yet."""
    key = (spark.sparkContext.applicationId, table, _state(spark, table))
    if key not in _built:
        path = f"{shared_folder(spark)}/quarry-index-{uuid.uuid4().hex}"
        build(spark, path)
        atexit.register(_drop, spark, path)
        _built[key] = path
    return read_index(spark, _built[key])


def forget(spark: SparkSession, table: str) -> None:
    """Deletes what is stored of a table."""
    for key in [k for k in _built if k[:2] == (spark.sparkContext.applicationId, table)]:
        _drop(spark, _built.pop(key))
