"""Writers of clean rows, exports and shared intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON records, null fields included."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export with every value quoted, inner quotes doubled and nulls as empty quotes."""
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """Folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="tallyboard-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own; the session is not changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder().name


class StoredTables:
    """Owns the tables that are stored while it is entered, by this thread or by work it hands on with ``in_parallel``.

    Leaving it keeps them; ``close`` removes them. Tables stored elsewhere are never its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._entered = spark, [], []

    def __enter__(self) -> StoredTables:
        self._entered.append(_OWNER.set(self))
        return self

    def __exit__(self, *_) -> None:
        _OWNER.reset(self._entered.pop())

    def close(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


_OWNER: ContextVar[StoredTables | None] = ContextVar("owner of what is stored", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tallyboard/{name}-{uuid.uuid4().hex}"
    if owner := _OWNER.get():
        owner.paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if not sys.is_finalizing() and spark.sparkContext._jsc:  # nothing can be removed through a session that is gone
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[StoredTables]:
    """Removes what is stored inside the block when it ends: read or write a report's result within it."""
    owner = StoredTables(spark)
    try:
        with owner:
            yield owner
    finally:
        owner.close()


def in_parallel(function: Callable, *arguments: Iterable) -> list:
    """``map`` over threads; what they store belongs to the caller's block."""
    calls = list(zip(*arguments))
    with ThreadPoolExecutor(max_workers=max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, function, *call) for call in calls]]


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: Counter[str] = Counter()  # tables that a session stores just now
_SETTING = Lock()


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query that is run inside the block removes its shuffle files when it ends; the session's setting is put back.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    name = str(spark._jsparkSession.sessionUUID())
    with _SETTING:
        mine = _WRITING[name] > 0 or spark.conf.get(_SHUFFLES_GO, "false") != "true"
        if mine:
            _WRITING[name] += 1
            spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        with _SETTING:
            if mine:
                _WRITING[name] -= 1
                if not _WRITING[name]:
                    spark.conf.set(_SHUFFLES_GO, "false")


def stage_table(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once as Parquet in the shared folder and read them back.

    For tables that several branches of a report read: the work before is done once, the branches
    scan only their columns, and a lost executor costs no recomputation.
    """
    path = fresh_path(rows.sparkSession, name)
    with _without_old_shuffles(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stage_tables(**rows: DataFrame) -> list[DataFrame]:
    """``stage_table`` of several frames that do not depend on each other, written at the same time."""
    return in_parallel(stage_table, rows.values(), [name.replace("_", "-") for name in rows])
