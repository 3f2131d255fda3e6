"""Relational operators: each takes and returns DataFrames, and leaves the physical plan to Catalyst.

Predicates and expressions may be text in the small languages, or Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import type_name
from ..functions.expressions import Columns, arithmetic, columns_of, predicate
from ..functions.parser import Cnf, Name, parse_cnf, parse_sort_order


def select_pipe(df: DataFrame, cnf: str | Cnf | Column, strict_types: bool = False) -> DataFrame:
    """Rows that satisfy a predicate. Over a scan, Catalyst pushes it into the reader."""
    return df.filter(cnf if isinstance(cnf, Column) else predicate(cnf, columns_of(df), strict_types))


def project(df: DataFrame, keep: list[int] | list[str]) -> DataFrame:
    """Columns by position or name, in that order; duplicates stay."""
    return df.select(*[F.col(f"`{df.columns[k] if isinstance(k, int) else k}`") for k in keep])


def _both(left: DataFrame, right: DataFrame) -> Columns:
    """Columns of two inputs, as l. and r.; a name that both have is the left one's."""
    return columns_of(right, "r") | columns_of(left, "l")


def join(left: DataFrame, right: DataFrame, cnf: str | Cnf, strict_types: bool = False, hint: str | None = None) -> DataFrame:
    """Inner join by a predicate: all columns of the left input, then all of the right one.

    Equalities become join keys; other predicates are conditions of the same join. hint: a Spark join
    hint, such as merge. A name that both inputs have is the left one's unless given as r.name.
    """
    tree = parse_cnf(cnf) if isinstance(cnf, str) else cnf
    right = right.hint(hint) if hint else right
    return left.alias("l").join(right.alias("r"), predicate(tree, _both(left, right), strict_types), "inner")


def equi_keys(left: DataFrame, right: DataFrame, cnf: str | Cnf) -> tuple[list[str], list[str]]:
    """The columns that single equalities between the inputs pair up."""
    a, b = [], []
    for group in parse_cnf(cnf) if isinstance(cnf, str) else cnf:
        c = group[0]
        if len(group) == 1 and c.op == "=" and isinstance(c.left, Name) and isinstance(c.right, Name):
            x, y = c.left.name, c.right.name
            if x in left.columns and y in right.columns:
                a, b = [*a, x], [*b, y]
            elif y in left.columns and x in right.columns:
                a, b = [*a, y], [*b, x]
    return a, b


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def _sum(df: DataFrame, expression: str | Column, unique: bool, legacy_assoc: bool) -> Column:
    e = expression if isinstance(expression, Column) else arithmetic(expression, columns_of(df), legacy_assoc)[0]
    return F.sum_distinct(e) if unique else F.sum(e)


def sum_of(df: DataFrame, expression: str | Column, unique: bool = False, legacy_assoc: bool = False) -> DataFrame:
    """One row with `sum`; 0 if there are no rows. Ints sum to a long, and unique sums different values once."""
    total_ = _sum(df, expression, unique, legacy_assoc)
    return df.agg(total_.alias("sum")).select(F.coalesce("sum", F.lit(0)).alias("sum"))


def sum_distinct_rows(df: DataFrame, expression: str | Column) -> DataFrame:
    """The sum over different whole rows."""
    return sum_of(df.distinct(), expression)


def group_by(df: DataFrame, keys: list[str], expression: str | Column, unique: bool = False, legacy_assoc: bool = False) -> DataFrame:
    """`sum` and the keys for each group; no rows give no groups. Sums are partial before the shuffle."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(_sum(df, expression, unique, legacy_assoc).alias("sum")).select("sum", *[F.col(f"`{k}`") for k in keys])


def sort(df: DataFrame, order: str | list[str]) -> DataFrame:
    """Ascending by the keys, of which text is `(a) AND (b)`."""
    return df.orderBy(*[F.col(f"`{k}`").asc() for k in (parse_sort_order(order) if isinstance(order, str) else order)])


def sort_all(df: DataFrame) -> DataFrame:
    """By all columns: the Ints, then the Doubles, then the Strings, each in the schema's order."""
    by = [f.name for kind in ("Int", "Double", "String") for f in df.schema if type_name(f.dataType) == kind]
    return sort(df, by)


def row_count(df: DataFrame) -> int:
    return df.count()


def total(df: DataFrame, expression: str) -> int | float:
    return sum_of(df, expression).first()["sum"]


def order_violations(df: DataFrame, keys: list[str]) -> int:
    """Neighbouring rows out of ascending order by keys, in the frame's order: every partition counts its own and gives its ends."""
    schema = ", ".join(f"{e}_{k} {df.schema[name].dataType.simpleString()}" for e in ("first", "last") for k, name in enumerate(keys))

    def falls(rows: pa.Table) -> int:
        """Rows smaller than the one before, compared column by column; nulls come first."""
        down = equal = None
        for c in rows.columns:
            was, now = c.slice(0, len(c) - 1), c.slice(1)
            less = pc.or_(pc.fill_null(pc.less(now, was), False), pc.and_(pc.is_null(now), pc.is_valid(was)))
            same = pc.or_(pc.fill_null(pc.equal(now, was), False), pc.and_(pc.is_null(now), pc.is_null(was)))
            down, equal = (less, same) if down is None else (pc.or_(down, pc.and_(equal, less)), pc.and_(equal, same))
        return pc.sum(down).as_py() or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, first, last = 0, None, None
        for b in batches:
            if b.num_rows:
                now = pa.Table.from_batches([b])
                bad += falls(now if last is None else pa.concat_tables([last, now]))
                first, last = first or now.slice(0, 1), now.slice(len(now) - 1)
        if first is not None:
            ends = [c.combine_chunks() for t in (first, last) for c in t.columns]
            names = [f"{e}_{k}" for e in ("first", "last") for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64()), *ends], names=["bad", *names])

    ends = df.select(*[F.col(f"`{k}`") for k in keys]).mapInArrow(run, f"bad long, {schema}").select(F.spark_partition_id().alias("p"), "*").collect()
    ends.sort(key=lambda r: r["p"])
    key = lambda r, e: tuple((x is not None, x.encode() if isinstance(x, str) else x) for x in (r[f"{e}_{k}"] for k in range(len(keys))))
    return sum(r["bad"] for r in ends) + sum(key(b, "first") < key(a, "last") for a, b in zip(ends, ends[1:], strict=False))
