"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written and not yet deleted.
_written: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a folder of its own; a cluster must name a shared one."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="bandscope-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A place for one table, deleted at the latest when the session's process ends."""
    path = f"{scratch_dir(spark)}/bandscope/{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    _written[path] = spark.sparkContext.applicationId
    return path


def delete(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)
    _written.pop(path, None)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables that are left of this session, once their results have been read; returns how many."""
    own = [p for p, app in _written.items() if app == spark.sparkContext.applicationId]
    for path in own:
        delete(spark, path)
    return len(own)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside, at its end: for work that has written its result by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            delete(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write the rows once to the session's checkpoint folder and read them back; lost executors lose nothing."""
    path = new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
