"""Relation schemas: three types, a text format, and a registry of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Type names of the text format and of CREATE TABLE.
TYPES = {"int": T.IntegerType(), "integer": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
_NAMES = {"int": "Int", "bigint": "Int", "smallint": "Int", "tinyint": "Int", "double": "Double", "float": "Double"}


def type_name(kind: T.DataType) -> str:
    """Int, Double or String for a Spark type; dates, times and anything else count as String."""
    return _NAMES.get(kind.simpleString(), "String")


@dataclass
class Relation:
    name: str
    schema: T.StructType
    file: str = ""
    kind: str = "heap"
    keys: list[str] = field(default_factory=list)


def struct(columns: list[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type name); values are never null."""
    unknown = [t for _, t in columns if t.lower() not in TYPES]
    if unknown:
        raise ValueError(f"unknown type {unknown[0]}; known are {', '.join(sorted(TYPES))}")
    return T.StructType([T.StructField(n, TYPES[t.lower()], False) for n, t in columns])


class Catalog:
    """Relations by name. Text format, for each: BEGIN, name, file, a line `column type` for each column, END."""

    def __init__(self) -> None:
        self.relations: dict[str, Relation] = {}

    def add(self, relation: Relation) -> None:
        self.relations[relation.name] = relation

    def __getitem__(self, name: str) -> Relation:
        if name not in self.relations:
            raise KeyError(f"no relation {name}")
        return self.relations[name]

    def __contains__(self, name: str) -> bool:
        return name in self.relations

    def drop(self, name: str) -> Relation:
        found = self[name]
        del self.relations[name]
        return found

    @classmethod
    def parse(cls, text: str) -> Catalog:
        out, block = cls(), None
        for line in filter(None, map(str.strip, text.splitlines())):
            if line == "BEGIN":
                block = []
            elif line == "END":
                if block is None or len(block) < 2:
                    raise ValueError("END without a relation's name and file")
                out.add(Relation(block[0], struct([tuple(x.split()) for x in block[2:]]), block[1]))
                block = None
            elif block is None:
                raise ValueError(f"outside a block: {line}")
            else:
                block.append(line)
        if block is not None:
            raise ValueError("a block without END")
        return out

    def format(self) -> str:
        blocks = []
        for r in self.relations.values():
            columns = [f"{f.name} {type_name(f.dataType)}" for f in r.schema]
            blocks.append("\n".join(["BEGIN", r.name, r.file or f"{r.name}.tbl", *columns, "END"]))
        return "\n\n".join(blocks) + "\n"
