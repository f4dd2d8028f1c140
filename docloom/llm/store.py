"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (read from the
session). Only where that setting is absent on a local master, as in tests, a
temporary folder is used; on a cluster its absence is an error. Lost executors cost
at most the stage in flight: what was written is read again from the shared folder.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query once it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a folder of this call's own below it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="docloom-"))
        top = _own[0]
    path = f"{top.rstrip('/')}/docloom-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it. Its shuffle files go with the write."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(f"{folder}/{tag}")
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{tag}")
    out._folder = folder
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect what a query has left (plans, and broadcasts and shuffles that nothing refers to), so that its heap doesn't grow from query to query."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written tables. Nothing that is still to be read may depend on them."""
    for t in tables:
        _delete(t._folder)


def written() -> set[str]:
    """Folders that were written and not deleted yet."""
    return set(_written)


def sweep(before: set[str], *keep: DataFrame) -> None:
    """Delete what was written since ``before`` but for the tables to keep. Nothing else that is still to be read may depend on it."""
    for folder in written() - before - {t._folder for t in keep}:
        _delete(folder)


def _delete(folder: str) -> None:
    spark = _written.pop(folder, None)
    if spark is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_end() -> None:
    """Results may read tables until the program ends; then what is left goes."""
    with contextlib.suppress(Exception):  # the session may be gone already
        for folder in list(_written):
            _delete(folder)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
