"""Declared tables: typed columns with roles, as Spark schemas with metadata.

A KEY column (exactly one) is matched and sharded by but never returned, INDEX
columns are matched and returned, all others are payload. INT, REAL, TEXT and
JSON are the declared types; other Spark types may be payload only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, types as T

from ..errors import InvalidArgument


class Role(str, Enum):
    KEY = "key"
    INDEX = "index"
    PAYLOAD = "payload"


class Kind(str, Enum):
    INT = "int"
    REAL = "real"
    TEXT = "text"
    JSON = "json"
    OTHER = "other"


SPARK_TYPES = {Kind.INT: T.LongType(), Kind.REAL: T.DoubleType(), Kind.TEXT: T.StringType(), Kind.JSON: T.StringType()}
KINDS = {T.ByteType: Kind.INT, T.ShortType: Kind.INT, T.IntegerType: Kind.INT, T.LongType: Kind.INT, T.FloatType: Kind.REAL, T.DoubleType: Kind.REAL, T.StringType: Kind.TEXT}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,255}")


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind = Kind.TEXT
    role: Role = Role.PAYLOAD

    @property
    def searchable(self) -> bool:
        return self.role is not Role.PAYLOAD


@dataclass(frozen=True)
class TableSchema:
    table: str
    columns: tuple[Column, ...]

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if not NAME.fullmatch(self.table or "") or not names:
            raise InvalidArgument("a table needs a name and columns")
        if bad := [n for n in names if not NAME.fullmatch(n)]:
            raise InvalidArgument(f"bad column name {bad[0]!r}")
        if len(set(names)) < len(names):
            raise InvalidArgument("column names repeat")
        if sum(c.role is Role.KEY for c in self.columns) != 1:
            raise InvalidArgument("a table has exactly one KEY column")
        if bad := [c.name for c in self.columns if c.searchable and c.kind not in (Kind.INT, Kind.TEXT)]:
            raise InvalidArgument(f"KEY and INDEX columns are INT or TEXT: {bad[0]}")

    @classmethod
    def of(cls, table: str, *columns: str) -> TableSchema:
        """``TableSchema.of("weather", "id INT KEY", "city TEXT INDEX", "note TEXT")``"""
        found = []
        for spec in columns:
            name, *rest = spec.split()
            words = [w.lower() for w in rest]
            if not words or words[0] not in ("int", "real", "text", "json") or words[1:] not in ([], ["key"], ["index"]):
                raise InvalidArgument(f"not a column: {spec!r}")
            found.append(Column(name, Kind(words[0]), Role(words[1]) if words[1:] else Role.PAYLOAD))
        return cls(table, tuple(found))

    @classmethod
    def over(cls, df: DataFrame, table: str, key: str, index: tuple[str, ...] = (), json: tuple[str, ...] = ()) -> TableSchema:
        """Roles given to the columns of an existing table."""
        role = lambda n: Role.KEY if n == key else Role.INDEX if n in index else Role.PAYLOAD
        kind = lambda f: Kind.JSON if f.name in json else KINDS.get(type(f.dataType), Kind.OTHER)
        return cls(table, tuple(Column(f.name, kind(f), role(f.name)) for f in df.schema.fields))

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:  # names are case-sensitive
                return c
        raise InvalidArgument(f"no column {name!r} in {self.table}")

    @property
    def key(self) -> Column:
        return next(c for c in self.columns if c.role is Role.KEY)

    @property
    def returned(self) -> list[str]:
        """What ``*`` stands for: all columns but the KEY, in order."""
        return [c.name for c in self.columns if c.role is not Role.KEY]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind], False, {"role": c.role.value, "kind": c.kind.value}) for c in self.columns])

    def to_json(self) -> list[list[str]]:
        return [[c.name, c.kind.value, c.role.value] for c in self.columns]

    @classmethod
    def from_json(cls, table: str, columns: list[list[str]]) -> TableSchema:
        return cls(table, tuple(Column(n, Kind(k), Role(r)) for n, k, r in columns))
