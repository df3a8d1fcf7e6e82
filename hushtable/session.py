"""The facade: tables, loads, lookups, counts and versions of one catalog, each call behind the gate.

Loads, inserts, status, versions and free SQL are for admins; lookups, counts,
scans and descriptions for anyone who may query. Who owns the files needs no
gate and may load by ``Catalog.publish(read_csv(...), ...)``.
"""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .access import Gate, Level
from .errors import NotFound
from .functions.codewords import BUCKETS, KEY_BITS
from .names import fresh
from .operators import bucketed, select as exact
from .plans.lookup import Lookup, Match, check, check_window
from .plans.schema import Kind, TableSchema
from .sources.csv_text import from_rows, read_csv, with_rid
from .sources.epochs import Catalog


class Session:
    def __init__(self, spark: SparkSession, base: str, gate: Gate, token: str | None = None, database: str = "default", strict: bool = True, node: str = "local"):
        self.spark, self.catalog, self.gate, self.token, self.database, self.strict, self.node = spark, Catalog(spark, base), gate, token, database, strict, node

    def _admit(self, level: Level) -> None:
        self.gate.admit(self.token, level)

    def load_csv(self, schema: TableSchema, path: str, most_bytes: int | None = None) -> int:
        self._admit(Level.ADMIN)
        return self.catalog.publish(read_csv(self.spark, path, schema, most_bytes), schema, self.database)

    def load(self, schema: TableSchema, df: DataFrame, order: str | None = None) -> int:
        self._admit(Level.ADMIN)
        return self.catalog.publish(with_rid(df, order), schema, self.database)

    def insert(self, table: str, *rows: tuple) -> int:
        self._admit(Level.ADMIN)
        schema = self.catalog.epoch(table, self.database).schema
        return self.catalog.append(from_rows(self.spark, schema, list(rows)), table, self.database)

    def lookup(self, table: str, *columns: str | tuple[str, str], where: Any = None, version: int | None = None, **window: Any) -> DataFrame:
        """All matches by value: ``lookup("weather", "city", where=eq("conditions", "Sunny"), order_by=("city",))``"""
        self._admit(Level.QUERY)
        epoch = self.catalog.epoch(table, self.database, version)
        request = Lookup(columns or ("*",), where, **window)
        return exact.select(self.catalog.read(table, self.database, epoch.version), request, epoch.schema, "rid", self.strict)

    def count(self, table: str, where: Any = None, version: int | None = None) -> DataFrame:
        self._admit(Level.QUERY)
        epoch = self.catalog.epoch(table, self.database, version)
        return exact.count(self.catalog.read(table, self.database, epoch.version), epoch.schema, where, self.strict)

    def private_lookup(self, table: str, *columns: str | tuple[str, str], where: Match, key_bits: int = KEY_BITS, buckets: int = BUCKETS, limit: int = 10, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """The clean rows in bucket order, and how many buckets collided."""
        self._admit(Level.QUERY)
        epoch = self.catalog.epoch(table, self.database)
        request = Lookup(columns or ("*",), where, limit=limit, offset=offset)
        check(request, epoch.schema)
        rows = bucketed.matching(self.catalog.read(table, self.database, epoch.version), epoch.schema, where, key_bits)
        (bucket,) = fresh(rows.rows, "bucket")
        clean = bucketed.clean_rows(rows, "rid", buckets, bucket).orderBy(bucket).offset(offset).limit(limit)
        return clean.select(*(F.col(s).alias(n) for s, n in request.projected(epoch.schema))), bucketed.collided(rows, buckets)

    def scan(self, table: str, limit: int = 10_000) -> DataFrame:
        self._admit(Level.QUERY)
        epoch = self.catalog.epoch(table, self.database)
        check_window(request := Lookup(limit=limit))
        return exact.presented(self.catalog.read(table, self.database), request, epoch.schema, "rid")

    def sql(self, text: str, **values: Any) -> DataFrame:
        """Spark SQL over the current versions, with named parameters (``:v``) for the values. For admins, as it can read and do anything."""
        self._admit(Level.ADMIN)
        for name in [r["table"] for r in self.catalog.tables().where(F.col("database") == self.database).collect()]:
            self.catalog.read(name, self.database).createOrReplaceTempView(name)
        return self.spark.sql(text, args=values)

    def status(self, table: str) -> dict[str, Any]:
        """Whether the table has a version, which is current, and its rows; and how this session is run."""
        self._admit(Level.ADMIN)
        own = {"node": self.node, "auth_mode": self.gate.mode, "cores": self.spark.sparkContext.defaultParallelism}
        try:
            epoch = self.catalog.epoch(table, self.database)
        except NotFound:
            return {"has_epoch": False, "version": 0, "rows": 0} | own
        return {"has_epoch": True, "version": epoch.version, "rows": epoch.rows} | own

    def principals(self) -> list[str]:
        self._admit(Level.ADMIN)
        return self.gate.principals()

    def tables(self) -> DataFrame:
        self._admit(Level.QUERY)
        return self.catalog.tables()

    def describe(self, table: str) -> DataFrame:
        self._admit(Level.QUERY)
        return self.catalog.describe(table, self.database)

    def epochs(self, table: str) -> DataFrame:
        self._admit(Level.ADMIN)
        return self.catalog.epochs(table, self.database)

    def rollback(self, table: str, version: int) -> None:
        self._admit(Level.ADMIN)
        self.catalog.rollback(table, version, self.database)


def rendered(df: DataFrame) -> str:
    """A result as an aligned table; results have a LIMIT."""
    rows = [[str(v) for v in r] for r in df.collect()]
    widths = [max(len(x.encode()) for x in column) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: " | ".join(c + " " * (w - len(c.encode())) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows)])


def shown(value: Any) -> str:
    """A value as text: reals with six digits."""
    return f"{value:g}" if isinstance(value, float) else str(value)


def named(df: DataFrame) -> list[str]:
    """A result with a LIMIT as lines of name=value."""
    return [" ".join(f"{c}={shown(v)}" for c, v in zip(df.columns, r, strict=True)) for r in df.collect()]


def raw(df: DataFrame, schema: TableSchema) -> list[bytes]:
    """A result with a LIMIT as payload records: eight bytes for a number, the length in two bytes and UTF-8 for text, without the zeros at the end."""
    packing = {Kind.INT: "<q", Kind.REAL: "<d"}

    def packed(kind: Kind, value: Any) -> bytes:
        text = b"" if kind in packing else str(value).encode()
        return struct.pack(packing[kind], value) if kind in packing else struct.pack("<H", len(text)) + text

    return [b"".join(packed(schema.column(c).kind, v) for c, v in zip(df.columns, r, strict=True)).rstrip(b"\0") for r in df.collect()]
