"""Lookups by codeword and bucket, with the results of single-server private retrieval.

The i-th row of a codeword (in storage order, within its shard) falls into
bucket (mix(codeword) + i) mod B. A bucket with one row returns it; one with
more is collided and returns none; the true count is the sum over buckets.

Counts by bucket follow from the number of rows of each codeword, so only
codewords with fewer than 2 B rows are numbered: a codeword with more has two
rows in every bucket. No hot codeword is ever sorted in one task.

The codeword and the shard of a row are columns of names that the table doesn't
have, and so is whatever else is added on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import InvalidArgument
from ..functions.codewords import BUCKETS, KEY_BITS, codeword, codeword_of, first_bucket
from ..names import fresh
from ..plans.lookup import Match, check_where
from ..plans.schema import TableSchema


@dataclass(frozen=True)
class Coded:
    """A table with a codeword and a shard for each row, and the names of these two columns."""

    rows: DataFrame
    cw: str
    shard: str

    def where(self, test: Column) -> Coded:
        return Coded(self.rows.where(test), self.cw, self.shard)


def with_codeword(df: DataFrame, schema: TableSchema, column: str, key_bits: int = KEY_BITS, shard: Column | None = None) -> Coded:
    cw, own = fresh(df, "cw", "shard")
    return Coded(df.select("*", codeword(column, schema.column(column).kind, key_bits).alias(cw), (F.lit("") if shard is None else shard).alias(own)), cw, own)


def matching(df: DataFrame, schema: TableSchema, where: Match, key_bits: int = KEY_BITS, shard: Column | None = None) -> Coded:
    """The rows whose codewords match. Values are told apart by codeword only, so text may match falsely."""
    check_where(where, schema)
    coded = with_codeword(df, schema, where.column, key_bits, shard)
    wanted = sorted({codeword_of(v, key_bits) for v in where.values})
    return coded.where(F.col(coded.cw) != wanted[0] if where.op == "<>" else F.col(coded.cw).isin(wanted))


def check_buckets(buckets: int) -> None:
    if buckets < 1 or buckets & (buckets - 1):
        raise InvalidArgument("the number of buckets is a power of two")


def codeword_counts(coded: Coded, buckets: int) -> DataFrame:
    """``s`` (shard), ``c`` (codeword), ``n`` (rows) and ``first`` (bucket of the first row)."""
    counts = coded.rows.select(F.col(coded.shard).alias("s"), F.col(coded.cw).alias("c")).groupBy("s", "c").agg(F.count("*").alias("n"))
    return counts.withColumn("first", first_bucket(F.col("c"), buckets))


def presence(coded: Coded, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``cnt`` over all shards, for buckets that hold rows."""
    check_buckets(buckets)
    counts = codeword_counts(coded, buckets)
    each = counts.select("first", "n", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(buckets)) - 1)).alias("i"))
    share = F.floor(F.col("n") / buckets) + F.when(F.col("i") < F.col("n") % buckets, 1).otherwise(0)
    return each.select(((F.col("first") + F.col("i")) % buckets).cast("int").alias("bucket"), share.alias("cnt")).groupBy("bucket").agg(F.sum("cnt").alias("cnt"))


def free_name(df: DataFrame, into: str) -> None:
    if into.lower() in {c.lower() for c in df.columns}:
        raise InvalidArgument(f"the table has a column {into}")


def placed(coded: Coded, rid: str, buckets: int = BUCKETS, into: str = "bucket") -> DataFrame:
    """The rows of codewords with fewer than 2 B rows, with ``into``."""
    free_name(coded.rows, into)
    s, c, first, at = fresh(coded.rows, "s", "c", "first", "at")
    few = codeword_counts(coded, buckets).where(F.col("n") < 2 * buckets).select(F.col("s").alias(s), F.col("c").alias(c), F.col("first").alias(first))
    joined = coded.rows.join(few, (F.col(coded.shard) == F.col(s)) & (F.col(coded.cw) == F.col(c)))
    position = F.row_number().over(Window.partitionBy(s, c).orderBy(rid)) - 1
    return joined.withColumn(at, position).withColumn(into, ((F.col(first) + F.col(at)) % buckets).cast("int")).drop(s, c, first, at)


def assigned(coded: Coded, rid: str, buckets: int = BUCKETS, block: int = 1 << 20, into: str = "bucket") -> DataFrame:
    """All rows with ``into``. Rows are numbered within blocks of storage order, so a hot codeword is dealt to many tasks."""
    check_buckets(buckets)
    free_name(coded.rows, into)
    own, at, s, c, b, before = fresh(coded.rows, "own", "at", "s", "c", "b", "before")
    key = [coded.shard, coded.cw, own]
    blocked = coded.rows.withColumn(own, F.floor(F.col(rid) / block))
    sizes = blocked.groupBy(*key).agg(F.count("*").alias("n"))
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy(*key[:2]).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(x).alias(y) for x, y in zip(key, (s, c, b), strict=True)), (so_far + first_bucket(F.col(coded.cw), buckets)).alias(before))
    joined = blocked.withColumn(at, F.row_number().over(Window.partitionBy(*key).orderBy(rid)) - 1).join(offsets, [F.col(x) == F.col(y) for x, y in zip(key, (s, c, b), strict=True)])
    return joined.withColumn(into, ((F.col(before) + F.col(at)) % buckets).cast("int")).drop(own, at, s, c, b, before)


def clean_rows(coded: Coded, rid: str, buckets: int = BUCKETS, into: str = "bucket") -> DataFrame:
    """The rows alone in their bucket, with ``into``, the bucket, which gives their order."""
    alone = presence(coded, buckets).where("cnt = 1").select(F.col("bucket").alias(into))
    return placed(coded, rid, buckets, into).join(alone, into)


def collided(coded: Coded, buckets: int = BUCKETS) -> DataFrame:
    return presence(coded, buckets).agg(F.count(F.when(F.col("cnt") > 1, 1)).alias("collided"))


def bucketed_count(coded: Coded, buckets: int = BUCKETS) -> DataFrame:
    return presence(coded, buckets).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("count_star"))
