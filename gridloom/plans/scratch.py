"""Tables written once in the folder that all executors share, and deleted when they are no longer needed."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a local folder if driver and executors are one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = getattr(folder, "own", None) or tempfile.mkdtemp(prefix="gridloom-")
        folder.own = found
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the scope or of the process."""
    path = f"{folder(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read again: lineage is cut, lost executors cost nothing."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables stored within are deleted at its end; what they are for must be written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            delete(spark, path)
        del _made[before:]


@atexit.register
def _clean() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return
