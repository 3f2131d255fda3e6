"""What the operators share: worker set-up, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import scratch, shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch; with the byte limit below it bounds what a Python worker holds.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Whether the shuffle files of a query go when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and bounds Arrow batches (kept if the user set them)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for key, was, now in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10000, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        at = spark.conf.get(key, str(was)).upper().removesuffix("B")
        if not at.isdigit() or int(at) >= was:
            spark.conf.set(key, str(now))
    return spark


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query made and run inside go when it ends, not when the driver's JVM next collects its garbage (kept if the user set that)."""
    was = spark.conf.get(FILES_GO, None)
    if was is None:
        spark.conf.set(FILES_GO, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(FILES_GO)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and fixes the rows that several readers see."""
    path = scratch(df.sparkSession, name)
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    with brief_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with one call of fn per batch."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives a worker's free memory back: workers are used again, and several live beside each other."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only: Parquet reads no others, and clashing extra columns stay out."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


class Splitter:
    """findall() and finditer() of a pattern that names letters, numbers and white space by their Unicode classes.

    White space is as Unicode defines it. Texts of ASCII characters alone go through the same pattern with
    ASCII classes, which is faster and finds the same in them.
    """

    def __init__(self, pattern: str):
        import re

        import regex

        self.any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern)
        plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = self.any if r"\p" in plain.lower() else re.compile(plain, re.ASCII)

    def findall(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)

    def finditer(self, text: str):
        return (self.ascii if text.isascii() else self.any).finditer(text)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def local_components(n: int, i, j):
    """Smallest index reachable from each of n nodes over the links (i, j)."""
    import numpy as np

    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)  # only roots move: a node that left its root would lose the others
        np.minimum.at(new, lab[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == lab).all():
            return lab
        lab = new
        on = lab[i] != lab[j]
        i, j = i[on], j[on]
    return lab
