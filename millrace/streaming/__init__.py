"""Continuous bulk loading: INSERT for text files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Relation
from ..sources.tables import Tables
from ..sources.text import load_text

FILES = "path string, modificationTime timestamp, length long, content binary"  # content isn't read here


def load_arrivals(spark: SparkSession, folder: str, relation: Relation, tables: Tables, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends every new file of a folder to a table; once: only those there now. The checkpoint keeps which files are in."""

    def add(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names of the files of one trigger
        if paths:
            tables.append(relation.name, load_text(spark, paths, relation.schema))

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", 1000).load(folder).select("path")
    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
