"""Heap and sorted tables: Parquet folders with a small description beside them.

A heap table appends. A sorted table keeps its rows in files of disjoint key ranges, each sorted, so a
lookup by key reads only the files and row groups whose bounds match; new rows are staged, every append in
a folder of its own, and merged before the next read, into a new folder that then replaces the old one.

A merge names the staged folders it took in the description, and only these are removed, then or, after a
crash, by the next one; rows staged meanwhile wait for it. The folder that was replaced stays until the
merge after, for frames that still read it. One session at a time may merge a table; any may append.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parser import Cnf, Literal, Name, parse_cnf
from ..operators.relational import select_pipe
from ..workspace import remove


def key_prefix(cnf: str | Cnf, keys: list[str]) -> list[tuple[str, int | float | str]]:
    """The leading keys that a predicate sets equal to literals, with these: what a lookup in key order can go by."""
    tree = parse_cnf(cnf) if isinstance(cnf, str) else cnf
    given = {}
    for group in tree:
        c = group[0]
        if len(group) == 1 and c.op == "=":
            for name, value in ((c.left, c.right), (c.right, c.left)):
                if isinstance(name, Name) and isinstance(value, Literal):
                    given.setdefault(name.name, value.value)
    out = []
    for k in keys:
        if k not in given:
            break
        out.append((k, given[k]))
    return out


class Tables:
    """The tables below a root folder, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # descriptions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/table.json")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return self._files(path).exists(path) or self._files(path).exists(path.suffix(".new"))

    def _staged(self, name: str) -> list[str]:
        """The staged folders that are written in full."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/staged")
        files = self._files(path)
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(f"staged/{p.getName()}" for p in found if files.exists(done(p, "_SUCCESS")))

    def describe(self, name: str) -> dict:
        """kind, keys, schema and the folder with the data; of sorted tables the folder before, and the staged folders merged last."""
        path = self._path(name)
        if not self._files(path).exists(path):
            path = path.suffix(".new")  # a description was being replaced
        if not self._files(path).exists(path):
            raise KeyError(f"no table {name}")
        stream = self._files(path).open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _save(self, name: str, about: dict) -> None:
        path, files = self._path(name), self._files(self._path(name))
        new = path.suffix(".new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        files.delete(path, False)
        files.rename(new, path)

    def create(self, name: str, schema: T.StructType, kind: str = "heap", keys: list[str] | None = None) -> None:
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        if kind not in ("heap", "sorted") or kind == "sorted" and not keys:
            raise ValueError("a table is a heap or sorted on at least one column")
        if unknown := [k for k in keys or () if k not in schema.names]:
            raise KeyError(f"no column {unknown[0]}")
        self._save(name, {"kind": kind, "keys": keys or [], "schema": schema.jsonValue(), "data": f"data-{uuid.uuid4().hex}"})

    def drop(self, name: str) -> None:
        self.describe(name)
        remove(self.spark, f"{self.root}/{name}")

    # rows

    def _read(self, name: str, folder: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{folder}")
        if not self._files(path).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{folder}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows, their columns taken in the table's order by position; a sorted table stages them until the next read."""
        about = self.describe(name)
        schema = T.StructType.fromJson(about["schema"])
        if len(rows.columns) != len(schema):
            raise ValueError(f"{name} has {len(schema)} columns, the rows have {len(rows.columns)}")
        rows = rows.toDF(*schema.names).select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in schema])
        if about["kind"] == "heap":
            rows.write.mode("append").parquet(f"{self.root}/{name}/{about['data']}")
        else:
            rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{name}/staged/{uuid.uuid4().hex}")

    def merge(self, name: str) -> None:
        """Merges the rows of a sorted table that are staged now."""
        about = self.describe(name)
        if about["kind"] != "sorted":
            return
        staged = self._staged(name)
        for folder in set(about.get("merged", [])) & set(staged):  # a merge ended before it removed them
            remove(self.spark, f"{self.root}/{name}/{folder}")
        staged = [folder for folder in staged if folder not in about.get("merged", [])]
        if not staged:
            return
        schema, keys = T.StructType.fromJson(about["schema"]), [F.col(f"`{k}`") for k in about["keys"]]
        new_rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{folder}" for folder in staged])
        rows = self._read(name, about["data"], schema).unionByName(new_rows)
        new, before = f"data-{uuid.uuid4().hex}", about.get("before")
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.root}/{name}/{new}")
        self._save(name, about | {"data": new, "before": about["data"], "merged": staged})
        for folder in [*staged, *([before] if before else [])]:
            remove(self.spark, f"{self.root}/{name}/{folder}")

    def read(self, name: str) -> DataFrame:
        """All rows, in no promised order."""
        self.merge(name)
        about = self.describe(name)
        return self._read(name, about["data"], T.StructType.fromJson(about["schema"]))

    def scan(self, name: str) -> DataFrame:
        """All rows; those of a sorted table in key order."""
        df, keys = self.read(name), self.describe(name)["keys"]
        return df.orderBy(*[F.col(f"`{k}`") for k in keys]) if keys else df

    def lookup(self, name: str, cnf: str | Cnf) -> DataFrame:
        """The rows that satisfy a predicate; equalities with keys (key_prefix()) prune files and row groups of a sorted table."""
        return select_pipe(self.read(name), cnf)
