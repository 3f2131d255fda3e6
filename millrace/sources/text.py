"""Delimited text: one record a line, every field ended by `|`. Readers, and the two text forms of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import type_name
from ..operators.relational import select_pipe

#: The longest numeric prefix, as C's atoi and atof take it.
_INT, _DOUBLE = r"^\s*([+-]?\d+)", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _value(text: Column, kind: T.DataType) -> Column:
    """A field's value: never null; a number is the numeric prefix of its text, or 0; an Int outside 32 bits is 0."""
    if isinstance(kind, T.StringType):
        return F.coalesce(text, F.lit(""))
    prefix = F.regexp_extract(F.coalesce(text, F.lit("")), _INT if isinstance(kind, T.IntegerType | T.LongType) else _DOUBLE, 1)
    return F.coalesce(prefix.try_cast(kind), F.lit(0).cast(kind))


def load_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A `.tbl` file as a frame without nulls; missing fields are empty, those beyond the schema are left out, empty lines too."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split("value", r"\|").alias("f"))
    return raw.select(*[_value(F.get("f", F.lit(k)), c.dataType).alias(c.name) for k, c in enumerate(schema)])


def scan_text(spark: SparkSession, path: str, schema: T.StructType, cnf: str) -> DataFrame:
    """The rows of a text file that satisfy a predicate."""
    return select_pipe(load_text(spark, path, schema), cnf)


def compose_record(spark: SparkSession, schema: T.StructType, text: str) -> DataFrame | None:
    """The record of one line; None if a field lacks its end."""
    fields = text.rstrip("\n").split("|")
    if len(fields) <= len(schema):
        return None
    one = spark.createDataFrame([(fields[: len(schema)],)], "f array<string>")
    return one.select(*[_value(F.col("f")[k], c.dataType).alias(c.name) for k, c in enumerate(schema)])


def _shown(col: Column, kind: T.DataType) -> Column:
    """Dates and times as ISO dates, as predicates see them; anything else as it is."""
    return (col.cast("date") if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else col).cast("string")


def lines(df: DataFrame) -> DataFrame:
    """Rows as text: `name: [value]` joined by `|`, doubles with six decimals."""
    parts = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        shown = F.when(col.isNotNull(), F.format_string("%.6f", col.cast("double"))) if type_name(f.dataType) == "Double" else _shown(col, f.dataType)
        parts.append(F.concat(F.lit(f"{f.name}: ["), F.coalesce(shown, F.lit("")), F.lit("]")))
    return df.select(F.concat_ws("|", *parts).alias("value"))


def write_out(df: DataFrame, path: str) -> None:
    """Writes lines() as text files in a folder."""
    lines(df).write.mode("overwrite").text(path)


def console_lines(df: DataFrame) -> DataFrame:
    """Rows as printed: `name: [value]` joined by `, `, doubles with six significant digits and no trailing zeros, as C rounds them."""

    @F.pandas_udf("string")
    def short(x: pd.Series) -> pd.Series:  # Java rounds ties up, and not the binary value
        return x.map("{:g}".format)

    parts = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        shown = F.when(col.isNotNull(), short(col.cast("double"))) if type_name(f.dataType) == "Double" else _shown(col, f.dataType)
        parts.append(F.concat(F.lit(f"{f.name}: ["), F.coalesce(shown, F.lit("")), F.lit("]")))
    return df.select(F.concat_ws(", ", *parts).alias("value"))
