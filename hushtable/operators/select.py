"""Exact lookups: the predicate goes to the scan, then projection, DISTINCT, order, OFFSET and LIMIT over all matches.

``rid``, the storage order of the rows, breaks ties and orders what no ORDER BY
orders, so results don't depend on how Spark deals the rows. A request for all
matches in no order (``limit=None``) is not sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..names import fresh
from ..plans.lookup import Lookup, check, check_where, predicate
from ..plans.schema import TableSchema


def matched(df: DataFrame, lookup: Lookup) -> DataFrame:
    return df if lookup.where is None else df.where(predicate(lookup.where))


def presented(df: DataFrame, lookup: Lookup, schema: TableSchema, rid: str) -> DataFrame:
    """Projects, keeps the first of equal rows (DISTINCT), orders (stable), skips and takes; names are given last."""
    shown = lookup.projected(schema)
    sources = list(dict.fromkeys(s for s, _ in shown))
    orders = lookup.orders()
    # the KEY may be the storage order itself, so what is sorted by gets names of its own
    place, *names = fresh(df, "rid", *(f"order{k}" for k in range(len(orders))))
    rows = df.select(*sources, *(F.col(c).alias(n) for n, (c, _) in zip(names, orders, strict=True)), F.col(rid).alias(place))
    if lookup.distinct:
        rows = rows.groupBy(*sources).agg(*(F.min_by(n, place).alias(n) for n in names), F.min(place).alias(place))
    if orders or lookup.offset or lookup.limit is not None:
        rows = rows.orderBy(*(F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, orders, strict=True)), F.asc(place))
    if lookup.offset:
        rows = rows.offset(lookup.offset)
    if lookup.limit is not None:
        rows = rows.limit(lookup.limit)
    return rows.select(*(F.col(s).alias(name) for s, name in shown))


def select(df: DataFrame, lookup: Lookup, schema: TableSchema, rid: str | None = None, strict: bool = True) -> DataFrame:
    check(lookup, schema, strict)
    return presented(matched(df, lookup), lookup, schema, rid or schema.key.name)


def count(df: DataFrame, schema: TableSchema, where=None, strict: bool = True) -> DataFrame:
    """COUNT(*): one row, one column; order and window don't apply."""
    if where is not None:
        check_where(where, schema, strict)
    return matched(df, Lookup(where=where)).agg(F.count("*").alias("count_star"))
