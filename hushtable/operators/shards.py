"""Sharding by consistent hash of the key, and combination of the shards' partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codewords import owner
from ..plans.schema import TableSchema
from . import bucketed


def shard_of(schema: TableSchema, nodes: list[str], database: str = "default") -> Column:
    """The owner of ``database.table.key``."""
    return owner(F.concat_ws(".", F.lit(database), F.lit(schema.table), F.col(schema.key.name).cast("string")), nodes)


def owner_counts(df: DataFrame, schema: TableSchema, nodes: list[str]) -> DataFrame:
    return df.groupBy(shard_of(schema, nodes).alias("owner")).agg(F.count("*").alias("rows"))


def owned(df: DataFrame, schema: TableSchema, nodes: list[str], node: str) -> DataFrame:
    """The rows that a node loads."""
    return df.where(shard_of(schema, nodes) == node)


def presence_by_shard(df: DataFrame, schema: TableSchema, where, nodes: list[str], key_bits: int, buckets: int = bucketed.BUCKETS) -> DataFrame:
    """Combined presence: each shard numbers its own rows, then the buckets are summed, so equal values of two shards may collide."""
    return bucketed.presence(bucketed.matching(df, schema, where, key_bits, shard_of(schema, nodes)), buckets)
