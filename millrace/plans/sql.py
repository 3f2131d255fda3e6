"""The SQL dialect: CREATE TABLE, INSERT, DROP TABLE, SET OUTPUT, SELECT, QUIT.

A SELECT becomes a DataFrame: predicates on one relation filter it, equalities between two are join
conditions, and whatever spans relations otherwise is applied above the joins. Relations are joined
along equalities as far as they connect them; the rest is a cross join. Catalyst chooses the order of
evaluation, pushes filters into scans and prunes columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Columns, arithmetic, cnf_text, columns_of, names_in
from ..functions.parser import Cnf, Comparison, Name, ParseError, Reader


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    kind: str
    keys: list[str] = field(default_factory=list)


@dataclass
class Insert:
    file: str
    table: str


@dataclass
class Drop:
    table: str


@dataclass
class SetOutput:
    target: str


@dataclass
class Quit:
    pass


@dataclass
class Select:
    names: list[str]
    tables: list[tuple[str, str]]  # relation, alias
    where: Cnf
    group_by: list[str]
    sum: object = None
    sum_distinct: bool = False
    distinct: bool = False


def parse_statement(text: str, legacy_assoc: bool = False) -> CreateTable | Insert | Drop | SetOutput | Quit | Select:
    """One statement, with or without a final semicolon; keywords in any case."""
    r = Reader(text)
    if r.take("CREATE"):
        out = _create(r)
    elif r.take("INSERT"):
        file = r.string()
        r.need("INTO")
        out = Insert(file, r.name())
    elif r.take("DROP"):
        r.need("TABLE")
        out = Drop(r.name())
    elif r.take("SET"):
        r.need("OUTPUT")
        out = SetOutput(f"'{r.string()}'" if r.peek()[0] == "string" else r.name().upper())
    elif r.take("QUIT"):
        out = Quit()
    elif r.take("SELECT"):
        out = _select(r, legacy_assoc)
    else:
        raise ParseError(f"a statement expected, found {r.peek()[1] or 'the end'!r}")
    r.take(";")
    r.done()
    return out


def _create(r: Reader) -> CreateTable:
    r.need("TABLE")
    name = r.name()
    r.need("(")
    columns = [(r.name(), r.name())]
    while r.take(","):
        columns.append((r.name(), r.name()))
    r.need(")")
    r.need("AS")
    if bad := [t for _, t in columns if t.upper() not in ("INTEGER", "DOUBLE", "STRING")]:
        raise ParseError(f"INTEGER, DOUBLE or STRING expected, found {bad[0]!r}")
    if r.take("HEAP"):
        return CreateTable(name, columns, "heap")
    r.need("SORTED")
    r.need("ON")
    return CreateTable(name, columns, "sorted", r.names())


def _select(r: Reader, legacy_assoc: bool) -> Select:
    out = Select([], [], [], [])
    if r.take("SUM"):
        out.sum_distinct = r.take("DISTINCT")
        r.need("(")
        out.sum = r.sum_of(legacy_assoc)
        r.need(")")
        out.names = r.names() if r.take(",") else []
    else:
        out.distinct = r.take("DISTINCT")
        out.names = r.names()
    r.need("FROM")
    while True:
        name = r.name()
        alias = r.name() if r.take("AS") else name
        if alias in [a for _, a in out.tables]:
            raise ParseError(f"alias {alias} is given twice")
        out.tables.append((name, alias))
        if not r.take(","):
            break
    if r.take("WHERE"):
        out.where = r.cnf()
    if r.take("GROUP"):
        r.need("BY")
        out.group_by = r.names()
    return out


@dataclass
class Bound:
    """A SELECT with its relations: predicates by the aliases they speak of."""

    columns: Columns
    own: dict[str, Cnf]  # on one relation
    equal: list[tuple[frozenset[str], Comparison]]  # between two
    above: Cnf  # any other


def bind(stmt: Select, frames: dict[str, DataFrame]) -> Bound:
    """frames: by alias. A column is named alias.column, or column if only one relation has it."""
    columns: Columns = {}
    owner: dict[str, set[str]] = {}
    for alias, df in frames.items():
        for name, ref in columns_of(df, alias).items():
            columns[name] = ref
            owner.setdefault(name, set()).add(alias)

    def alias_of(name: str) -> str:
        if name not in owner:
            raise KeyError(f"no column {name}")
        if len(owner[name]) > 1:
            raise KeyError(f"{name} is in {' and '.join(sorted(owner[name]))}; put its alias before it")
        return next(iter(owner[name]))

    out = Bound(columns, {}, [], [])
    for group in stmt.where:
        used = {alias_of(n) for n in names_in(group)}
        c = group[0]
        if len(used) == 1:
            out.own.setdefault(next(iter(used)), []).append(group)
        elif len(group) == 1 and len(used) == 2 and c.op == "=" and isinstance(c.left, Name) and isinstance(c.right, Name):
            out.equal.append((frozenset(used), c))
        else:
            out.above.append(group)
    for name in [*stmt.names, *stmt.group_by, *names_in(stmt.sum)]:
        alias_of(name)
    return out


def _outputs(stmt: Select, columns: Columns, names: list[str]) -> list[tuple[str, str]]:
    """(name as written, output name): plain column names, with their alias where two would be the same."""
    short = [n.rpartition(".")[2] for n in names]
    return [(n, s if short.count(s) == 1 and s != "sum" else n.replace(".", "_")) for n, s in zip(names, short, strict=True)]


def _resolve(name: str, frames: dict[str, DataFrame]) -> tuple[str, str]:
    """(alias, column) of a name; bind() has found it to be of one relation."""
    alias, _, column = name.rpartition(".")
    return alias or next(a for a, df in frames.items() if column in df.columns), column


def _ref(name: str, frames: dict[str, DataFrame]) -> Column:
    alias, column = _resolve(name, frames)
    return F.col(f"`{alias}`.`{column}`")


def _grouped(stmt: Select, names: list[str], frames: dict[str, DataFrame]) -> None:
    """Every name must be grouped by: the same column of the same relation."""
    keys = {_resolve(g, frames) for g in stmt.group_by}
    if extra := [n for n in names if _resolve(n, frames) not in keys]:
        raise ParseError(f"{extra[0]} is neither summed nor grouped by")


def run_select(stmt: Select, table: Callable[[str], DataFrame], strict_types: bool = False, order: list[Comparison] | None = None) -> DataFrame:
    """The SELECT as a DataFrame. table: the frame of a relation; order: the join predicates in the order to join by, as far as it goes."""
    frames = {alias: table(name) for name, alias in stmt.tables}
    bound = bind(stmt, frames)
    parts = {}
    for alias, df in frames.items():
        parts[alias] = df.alias(alias)
        if alias in bound.own:
            parts[alias] = parts[alias].where(cnf_text(bound.own[alias], bound.columns, strict_types))
    todo, joined = list(parts), set()
    for c in reversed(order or []):  # the relations of the first predicate come first
        by = next((pair for pair, x in bound.equal if x == c), frozenset())
        todo.sort(key=lambda a: a not in by)  # noqa: B023  stable
    df = None
    left = list(bound.equal)
    while todo:
        alias = next((a for a in todo if any(a in pair and pair - {a} <= joined for pair, _ in left)), todo[0])
        todo.remove(alias)
        joined.add(alias)
        on = [c for pair, c in left if pair <= joined]
        left = [x for x in left if not x[0] <= joined]
        if df is None:
            df = parts[alias]
        elif on:
            df = df.join(parts[alias], F.expr(cnf_text([[c] for c in on], bound.columns, strict_types)), "inner")
        else:
            df = df.crossJoin(parts[alias])
    if bound.above:
        df = df.where(cnf_text(bound.above, bound.columns, strict_types))

    if stmt.sum is None:
        names = stmt.names
        if stmt.group_by:
            _grouped(stmt, names, frames)
        out = df.select(*[_ref(n, frames).alias(o) for n, o in _outputs(stmt, bound.columns, names)])
        return out.distinct() if stmt.distinct or stmt.group_by else out
    value, _ = arithmetic(stmt.sum, bound.columns)
    value = F.sum_distinct(value) if stmt.sum_distinct else F.sum(value)
    if not stmt.group_by:
        if stmt.names:
            raise ParseError(f"{stmt.names[0]} is neither summed nor grouped by")
        return df.agg(value.alias("sum")).select(F.coalesce("sum", F.lit(0)).alias("sum"))
    shown = stmt.names or stmt.group_by
    _grouped(stmt, shown, frames)
    unique = list({_resolve(n, frames): n for n in stmt.group_by}.values())
    keys = _outputs(stmt, bound.columns, unique)
    known = {_resolve(n, frames): o for n, o in keys}
    out = df.groupBy(*[_ref(n, frames).alias(o) for n, o in keys]).agg(value.alias("sum"))
    return out.select("sum", *[known[_resolve(n, frames)] for n in shown])
