"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Tables stored within scope(name): they go when the scope is entered anew, others stay.
_SCOPED: dict[str, list[tuple[SparkSession, str]]] = {}
_NOW: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in local mode (tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="talkatlas-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables stored inside belong to this scope; what an earlier run of the same scope stored is deleted first. So a chain
    of stages holds the tables of one stage at a time, and results made elsewhere are left alone."""
    _delete(_SCOPED.pop(name, []))
    before = _NOW.set(name)
    try:
        yield
    finally:
        _NOW.reset(before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: lineage is cut, and a lost
    executor costs no recomputation of what came before. Tables go at exit, by drop(), or with their scope."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/talkatlas/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    own = _NOW.get()
    (_WRITTEN if own is None else _SCOPED.setdefault(own, [])).append((spark, path))
    _sweep(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at__ = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    paths = {t.stored_at__ for t in tables}
    for tables_ in (_WRITTEN, *_SCOPED.values()):
        gone = [x for x in tables_ if x[1] in paths]
        tables_[:] = [x for x in tables_ if x[1] not in paths]
        _delete(gone)


def _sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of what has just been stored: it learns of
    them by the driver's garbage collection, which else may be far off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


@atexit.register
def _at_exit() -> None:
    for tables in (_WRITTEN, *_SCOPED.values()):
        _delete(tables)
