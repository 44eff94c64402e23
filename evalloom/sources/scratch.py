"""Intermediate tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Setting of Spark that deletes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` (or ``setCheckpointDir``) names.

    Where neither is set, a session on a ``local`` master gets one temporary folder;
    on a cluster that is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL[app]


def scratch(spark: SparkSession) -> str:
    """A new folder name below :func:`shared_folder`."""
    path = f"{shared_folder(spark)}/evalloom-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """Folders that :func:`scratch` named in this session and :func:`discard` has not deleted."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends, instead of when the driver's garbage collection finds them unused."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once as parquet and read it back.

    For results that several passes read: without it each pass would compute them again.
    The files outlive lost executors, and later passes still prune columns. The rows read
    back are counted against the rows written. The shuffle files of the write are deleted once it is done.
    """
    spark = df.sparkSession
    path = scratch(spark)
    seen = Observation()
    with _shuffles_freed(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    written, read = seen.get.get("n", 0), out.count()
    if written != read:
        raise RuntimeError(f"{path}: {written} rows written, {read} read; is the folder shared by all executors?")
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder that :func:`scratch` named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession) -> int:
    """Delete every scratch folder of this session; call it once results are stored elsewhere. Returns how many."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove(spark, path)
    return len(made)
