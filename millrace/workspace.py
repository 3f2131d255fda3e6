"""Folders that the driver and the executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only for a local master, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_made: list[str] = []


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that scratch() gives out inside, when the block ends: results that read them must have been written by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [x for x in _made if x not in before]:
            remove(spark, path)
            _made.remove(path)


def forget(df: DataFrame) -> None:
    """Removes the folders of scratch() that df reads, which nothing may read any more."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}  # they are unique
    for path in [x for x in _made if x.rsplit("/", 1)[1] in names]:
        remove(df.sparkSession, path)
        _made.remove(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the block of short_lived() or else the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone already
            pass

    atexit.register(drop)
    return path
