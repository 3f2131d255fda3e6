"""A session: tables, registered frames, and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog, Relation, struct
from .plans.estimator import Statistics
from .plans.explain import join_order, plan_text
from .plans.sql import CreateTable, Drop, Insert, Quit, Select, SetOutput, parse_statement, run_select
from .sources.tables import Tables
from .sources.text import console_lines, load_text, write_out
from .workspace import scratch


class Session:
    """Runs statements. root: the folder of the tables; files: the folder from which INSERT loads; registered frames are read only."""

    def __init__(self, spark: SparkSession, root: str | None = None, files: str = ".", catalog: Catalog | None = None):
        self.spark = spark
        self._root, self.files, self.output, self.closed = root, files.rstrip("/"), "STDOUT", False
        self.catalog, self.frames, self.statistics = catalog or Catalog(), {}, Statistics()
        self._tables: Tables | None = None

    @property
    def tables(self) -> Tables:
        if self._tables is None:
            self._tables = Tables(self.spark, self._root or scratch(self.spark, "tables"))
        return self._tables

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a frame known as a relation."""
        self.frames[name] = df

    def register_parquet(self, folder: str, *names: str) -> None:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.tables.exists(name):
            return self.tables.read(name)
        if name in self.catalog:
            return load_text(self.spark, f"{self.files}/{self.catalog[name].file}", self.catalog[name].schema)
        raise KeyError(f"no relation {name}")

    def analyze(self, name: str) -> None:
        """Collects a relation's statistics from its rows."""
        self.statistics.collect(name, self.table(name))

    def select(self, text: str, strict_types: bool = False, legacy_assoc: bool = False) -> DataFrame:
        """The result of a SELECT as a DataFrame, whatever the output target."""
        stmt = parse_statement(text, legacy_assoc)
        if not isinstance(stmt, Select):
            raise ValueError("not a SELECT")
        return run_select(stmt, self.table, strict_types, self._order(stmt))

    def _order(self, stmt: Select) -> list | None:
        """The greedy join order, if statistics of all relations are known; else that of FROM."""
        if len(stmt.tables) < 3 or any(name not in self.statistics.relations for name, _ in stmt.tables):
            return None
        return [c for c, _ in join_order(stmt, {alias: self.table(name) for name, alias in stmt.tables}, self.statistics)]

    def explain(self, text: str) -> str:
        stmt = parse_statement(text)
        known = all(name in self.statistics.relations for name, _ in stmt.tables)
        return plan_text(stmt, self.table, self.statistics if known else None)

    def execute(self, text: str) -> DataFrame | str | None:
        """Runs one statement. A SELECT goes to the output target: NONE returns its plan, STDOUT prints the rows, a path gets text files."""
        if self.closed:
            raise RuntimeError("the session has quit")
        stmt = parse_statement(text)
        if isinstance(stmt, CreateTable):
            self.tables.create(stmt.name, struct(stmt.columns), stmt.kind, stmt.keys)
            self.catalog.add(Relation(stmt.name, struct(stmt.columns), f"{stmt.name}.tbl", stmt.kind, stmt.keys))
        elif isinstance(stmt, Insert):
            schema = self.catalog[stmt.table].schema if stmt.table in self.catalog else self.tables.read(stmt.table).schema
            path = stmt.file if "://" in stmt.file or stmt.file.startswith("/") else f"{self.files}/{stmt.file}"
            self.tables.append(stmt.table, load_text(self.spark, path, schema))
        elif isinstance(stmt, Drop):
            self.tables.drop(stmt.table)
            if stmt.table in self.catalog:
                self.catalog.drop(stmt.table)
        elif isinstance(stmt, SetOutput):
            if stmt.target not in ("STDOUT", "NONE") and not stmt.target.startswith("'"):
                raise ValueError(f"output is STDOUT, NONE or a path in quotes, not {stmt.target}")
            self.output = stmt.target.strip("'") if stmt.target.startswith("'") else stmt.target
        elif isinstance(stmt, Quit):
            self.closed = True
        else:
            if self.output == "NONE":
                return self.explain(text)
            df = run_select(stmt, self.table, order=self._order(stmt))
            if self.output == "STDOUT":
                for row in console_lines(df).toLocalIterator():
                    print(row["value"])
            else:
                write_out(df, self.output)
            return df
        return None
