"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidevec-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def place(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in a folder of this application's own."""
    folder = f"{shared_root(spark)}/tidevec/{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        _MADE.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables that this application has made; results that weren't written yet go with them."""
    _delete(spark, f"{shared_root(spark)}/tidevec/{spark.sparkContext.applicationId}")


def _forget(spark: SparkSession, folder: str) -> None:
    """At the end of the program, if its context still runs."""
    with contextlib.suppress(Exception):
        if not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later jobs neither recompute it nor depend on lost executors, and its shuffle files go."""
    spark = df.sparkSession
    path, before = place(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect(spark: SparkSession, share: int = 3) -> None:
    """Collect the driver's garbage once over 1/``share`` of its heap is in use.

    Plans and what finished queries told their tasks (bit tables by the megabyte, on executors too) go only then; until
    Spark asks for it, every 30 minutes, the heap grows to its limit.
    """
    java = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if (java.totalMemory() - java.freeMemory()) * share > java.maxMemory():
        java.gc()


def give_back() -> None:
    """Give the memory that this Python process has freed back to the system, where its C library can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that no later job reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidevec/" in folder:
            _delete(df.sparkSession, folder)
