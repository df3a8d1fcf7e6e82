"""The registered lookups over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.codewords import FNV_PRIME, RING_BASIS, VIRTUAL_NODES, codeword, first_bucket, record_bytes
from .names import scratch
from .operators import bucketed, select, shards
from .plans.lookup import Lookup, both, compare, either, eq, ne, one_of
from .plans.schema import Kind, TableSchema
from .shipping import ship
from .sources.csv_text import read_csv, with_rid
from .sources.epochs import Catalog
from .streaming.publish import publish_stream

#: KEY and INDEX columns of the driver's tables; the rest is payload.
ROLES = {
    "region": ("r_regionkey", ("r_name",)), "nation": ("n_nationkey", ("n_name", "n_regionkey")), "customer": ("c_custkey", ("c_name", "c_nationkey", "c_mktsegment")),
    "supplier": ("s_suppkey", ("s_name", "s_nationkey")), "part": ("p_partkey", ("p_name", "p_brand", "p_type", "p_size")),
    "orders": ("o_orderkey", ("o_custkey", "o_orderstatus", "o_orderpriority")), "lineitem": ("l_orderkey", ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")),
    "events": ("event_id", ("user_id", "event_type")),
}
NODES = ["node1", "node2", "node3"]


def opened(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, TableSchema]:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, index = ROLES[name]
    return df, TableSchema.over(df, name, key, index, json=("props",))


def looked_up(table: str, *columns, where=None, strict: bool = True, **window) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, schema = opened(spark, sf_dir, table)
        return select.select(df, Lookup(columns or ("*",), where, **window), schema, strict=strict)

    return run


def counted(table: str, where=None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, schema = opened(spark, sf_dir, table)
        return select.count(df, schema, where)

    return run


def in_buckets(table: str, where, use: Callable[..., DataFrame], key_bits: int = 32) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, schema = opened(spark, sf_dir, table)
        return use(bucketed.matching(df, schema, where, key_bits), schema)

    return run


# DuckDB forms of the codeword (FNV-1a of UTF-8 text, 16 bits) and of the bucket mix.
def fnv16(column: str) -> str:
    return f"list_reduce(list_concat([8997::BIGINT], list_transform(range(1, length({column}) + 1), lambda i: ord(substr({column}, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 435) % 65536)"


U = "18446744073709551616::UHUGEINT"


def mix16(column: str) -> str:
    a = f"(({column})::UHUGEINT + 11400714819323198485::UHUGEINT) % {U}"
    b = f"(xor({a}, ({a}) >> 30) * 13787848793156543929::UHUGEINT) % {U}"
    c = f"(xor({b}, ({b}) >> 27) * 10723151780598845931::UHUGEINT) % {U}"
    return f"(xor({c}, ({c}) >> 31) % 16::UHUGEINT)::BIGINT"


def placed_sql(table: str, column: str, key: str, where: str, columns: str) -> str:
    return f"SELECT {columns}, (({mix16(column)}) + row_number() OVER (PARTITION BY {column} ORDER BY {key}) - 1) % 16 AS bucket FROM {table} WHERE {where}"


def clean_sql(table: str, column: str, key: str, where: str, columns: str) -> str:
    return f"WITH p AS ({placed_sql(table, column, key, where, columns)}) SELECT {columns}, CAST(bucket AS INTEGER) AS bucket FROM p QUALIFY count(*) OVER (PARTITION BY bucket) = 1"


def presence_sql(table: str, column: str, key: str, where: str) -> str:
    return f"SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS cnt FROM ({placed_sql(table, column, key, where, key)}) GROUP BY bucket"


def fnv64(column: str, basis: int = RING_BASIS) -> str:
    return f"list_reduce(list_concat([{basis}::UHUGEINT], list_transform(range(1, length({column}) + 1), lambda i: ord(substr({column}, i, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * {FNV_PRIME}::UHUGEINT) % {U})"


def owner_sql(table: str, key: str) -> str:
    """The rows of a table with ``owner``: the node of the first point of the ring at or after the hash of the key."""
    nodes = ", ".join(f"('{n}')" for n in NODES)
    return f"""
WITH points AS (SELECT {fnv64("s")} AS p, node FROM (SELECT node, node || '#' || v AS s FROM (VALUES {nodes}) AS n(node), range({VIRTUAL_NODES}) AS r(v))),
keyed AS (SELECT *, {fnv64("s")} AS h FROM (SELECT *, 'default.{table}.' || {key} AS s FROM {table})),
owned AS (SELECT keyed.*, coalesce(node, (SELECT arg_min(node, p) FROM points)) AS owner FROM keyed ASOF LEFT JOIN points ON keyed.h <= points.p)"""


def clean(*columns: str) -> Callable[..., DataFrame]:
    return lambda rows, schema: bucketed.clean_rows(rows, schema.key.name).select(*columns, "bucket")


def codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = opened(spark, sf_dir, "customer")
    return df.select("c_mktsegment").distinct().select("c_mktsegment", codeword("c_mktsegment", Kind.TEXT).alias("codeword"))


def codeword_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = opened(spark, sf_dir, "customer")
    names = df.select("c_name", codeword("c_name", Kind.TEXT).alias("codeword"))
    return names.groupBy("codeword").agg(F.countDistinct("c_name").alias("n_values")).where("n_values > 1")


def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, schema = opened(spark, sf_dir, "orders")
    rows = bucketed.with_codeword(df, schema, "o_custkey", 32)
    return bucketed.assigned(rows, "o_orderkey").select("o_orderkey", "bucket")


def mix_of_codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = opened(spark, sf_dir, "nation")
    return df.select("n_nationkey", first_bucket(F.col("n_nationkey").cast("long")).alias("first_bucket"))


def owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, schema = opened(spark, sf_dir, "customer")
    return shards.owner_counts(df, schema, NODES)


def shard_combine_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, schema = opened(spark, sf_dir, "customer")
    parts = df.where(F.col("c_mktsegment") == "BUILDING").groupBy(shards.shard_of(schema, NODES).alias("owner")).agg(F.count("*").alias("n"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count_star"))


def shard_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, schema = opened(spark, sf_dir, "orders")
    return shards.presence_by_shard(df, schema, eq("o_custkey", 7), NODES, 32)


def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, schema = opened(spark, sf_dir, "customer")
    return df.select("c_custkey", record_bytes(schema).alias("record_bytes"))


def epochs_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes nations, appends them with other names, rolls back and publishes again; the rows of each version."""
    df, schema = opened(spark, sf_dir, "nation")
    catalog = Catalog(spark, scratch(spark, "tables"))
    first = catalog.publish(with_rid(df, "n_nationkey"), schema)
    second = catalog.append(with_rid(df.withColumn("n_name", F.lower("n_name")), "n_nationkey"), "nation")
    catalog.rollback("nation", first)
    third = catalog.publish(with_rid(df.where("n_regionkey = 1"), "n_nationkey"), schema)
    parts = [catalog.read("nation", version=v).select(F.lit(v).cast("long").alias("version"), "n_name") for v in (first, second, third)]
    return parts[0].union(parts[1]).union(parts[2])


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared columns of a published table."""
    df, schema = opened(spark, sf_dir, "nation")
    catalog = Catalog(spark, scratch(spark, "tables"))
    catalog.publish(with_rid(df, "n_nationkey"), schema)
    return catalog.describe("nation")


def epoch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions after two loads, an append, a rollback and a prune to two versions."""
    df, schema = opened(spark, sf_dir, "nation")
    catalog = Catalog(spark, scratch(spark, "tables"))
    rows = with_rid(df, "n_nationkey")
    for _ in range(2):
        catalog.publish(rows, schema)
    catalog.append(rows, "nation")
    catalog.publish(rows.where("n_regionkey = 1"), schema)
    catalog.rollback("nation", 1)
    catalog.prune("nation", keep=2)
    return catalog.epochs("nation")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes suppliers as CSV text, the header in a file of its own, and loads them with all checks."""
    df, _ = opened(spark, sf_dir, "supplier")
    at = scratch(spark, "supplier")
    line = F.concat_ws(",", "s_suppkey", F.concat(F.lit(" "), "s_name"), "s_nationkey", F.lit("ignored"))
    head = spark.createDataFrame([("s_suppkey,s_name,s_nationkey,extra",)], "value string")
    head.coalesce(1).write.text(f"{at}/0")
    df.select(line.alias("value")).write.text(f"{at}/1")
    schema = TableSchema.of("supplier", "s_suppkey INT KEY", "s_name TEXT INDEX", "s_nationkey INT INDEX")
    return read_csv(spark, f"{at}/*", schema, 128).select("s_suppkey", "s_name", "s_nationkey")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams events into versions of a table and counts them by type."""
    df, schema = opened(spark, sf_dir, "events")
    at = scratch(spark, "events")
    catalog = Catalog(spark, f"{at}/tables")
    stream = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/events.parquet*")
    publish_stream(stream, catalog, schema, f"{at}/stream").awaitTermination()
    return catalog.read("events").groupBy("event_type").agg(F.count("*").alias("count_star"))


def presence_rows(rows: bucketed.Coded, schema: TableSchema) -> DataFrame:
    return bucketed.presence(rows).select("bucket", F.col("cnt").cast("long").alias("cnt"))


ORDER_KEY = "o_orderkey"
#: name: (query, SQL or None)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "eq_key": (looked_up("orders", "o_custkey", "o_orderstatus", "o_totalprice", where=eq("o_orderkey", 42)), "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42"),
    "eq_index_int": (looked_up("orders", "o_orderstatus", "o_totalprice", where=eq("o_custkey", 7), limit=None), "SELECT o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7"),
    "eq_index_text": (looked_up("customer", "c_name", "c_acctbal", where=eq("c_mktsegment", "BUILDING"), order_by=("c_name",)), "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 10"),
    "eq_absent": (looked_up("customer", "c_name", where=eq("c_mktsegment", "NOPE")), "SELECT c_name FROM customer WHERE c_mktsegment = 'NOPE'"),
    "eq_key_zero": (looked_up("nation", "n_name", "n_regionkey", where=eq("n_nationkey", 0)), "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 0"),
    "ne_index": (looked_up("customer", "c_name", "c_mktsegment", where=ne("c_mktsegment", "BUILDING"), limit=None), "SELECT c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "ne_bang": (looked_up("nation", "n_name", where=ne("n_regionkey", 1), limit=None), "SELECT n_name FROM nation WHERE n_regionkey != 1"),
    "in_text": (looked_up("orders", "o_totalprice", "o_orderpriority", where=one_of("o_orderpriority", "1-URGENT", "5-LOW"), limit=None), "SELECT o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "in_int_key": (looked_up("part", "p_name", "p_brand", where=one_of("p_partkey", 1, 5, 9)), "SELECT p_name, p_brand FROM part WHERE p_partkey IN (1, 5, 9)"),
    "in_dup": (looked_up("part", "p_name", where=one_of("p_partkey", 5, 5)), "SELECT p_name FROM part WHERE p_partkey IN (5, 5)"),
    "or_same_col": (looked_up("customer", "c_name", where=either(eq("c_mktsegment", "BUILDING"), eq("c_mktsegment", "FURNITURE")), limit=None), "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'FURNITURE'"),
    "count_eq": (counted("customer", eq("c_mktsegment", "BUILDING")), "SELECT count(*) AS count_star FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "count_ne": (counted("events", ne("event_type", "click")), "SELECT count(*) AS count_star FROM events WHERE event_type <> 'click'"),
    "count_in": (counted("orders", one_of("o_orderpriority", "1-URGENT", "2-HIGH")), "SELECT count(*) AS count_star FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "count_scan": (counted("lineitem"), "SELECT count(*) AS count_star FROM lineitem"),
    "star_excludes_key": (looked_up("nation", where=eq("n_regionkey", 1), limit=None), "SELECT * EXCLUDE (n_nationkey) FROM nation WHERE n_regionkey = 1"),
    "alias": (looked_up("customer", ("c_name", "customer"), ("c_acctbal", "balance"), where=eq("c_nationkey", 3), order_by=("c_name",)), "SELECT c_name AS customer, c_acctbal AS balance FROM customer WHERE c_nationkey = 3 ORDER BY c_name, c_custkey LIMIT 10"),
    "scan_default_limit": (looked_up("customer", "c_name"), "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 10"),
    "scan_order_multi": (looked_up("customer", "c_name", "c_mktsegment", order_by=(("c_mktsegment", "desc"), "c_name"), limit=25), "SELECT c_name, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_name, c_custkey LIMIT 25"),
    "order_by_unprojected": (looked_up("customer", "c_name", order_by=(("c_acctbal", "desc"),), limit=5), "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5"),
    "offset_only": (looked_up("customer", "c_name", order_by=("c_name",), offset=1490), "SELECT c_name FROM customer ORDER BY c_name, c_custkey LIMIT 10 OFFSET 1490"),
    "limit_offset": (looked_up("customer", "c_name", order_by=("c_name",), limit=5, offset=7), "SELECT c_name FROM customer ORDER BY c_name, c_custkey LIMIT 5 OFFSET 7"),
    "distinct": (looked_up("customer", "c_mktsegment", distinct=True, order_by=("c_mktsegment",)), "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 10"),
    "distinct_order_unprojected": (looked_up("customer", "c_mktsegment", "c_nationkey", distinct=True, order_by=("c_acctbal",), limit=20), "SELECT c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1 ORDER BY c_acctbal, c_custkey LIMIT 20"),
    "codeword_text16": (codewords, f"SELECT c_mktsegment, {fnv16('c_mktsegment')} AS codeword FROM (SELECT DISTINCT c_mktsegment FROM customer)"),
    "codeword_collisions": (codeword_collisions, f"SELECT codeword, count(DISTINCT c_name) AS n_values FROM (SELECT c_name, {fnv16('c_name')} AS codeword FROM customer) GROUP BY codeword HAVING count(DISTINCT c_name) > 1"),
    "mix_of_codewords": (mix_of_codewords, f"SELECT n_nationkey, CAST({mix16('n_nationkey')} AS INTEGER) AS first_bucket FROM nation"),
    "bucket_assign": (bucket_assign, f"SELECT o_orderkey, CAST(bucket AS INTEGER) AS bucket FROM ({placed_sql('orders', 'o_custkey', ORDER_KEY, 'true', ORDER_KEY)})"),
    "presence_eq": (in_buckets("orders", eq("o_custkey", 7), presence_rows), presence_sql("orders", "o_custkey", ORDER_KEY, "o_custkey = 7")),
    "bucketed_rows_eq": (in_buckets("orders", eq("o_custkey", 7), clean("o_orderstatus", "o_totalprice")), clean_sql("orders", "o_custkey", ORDER_KEY, "o_custkey = 7", "o_orderstatus, o_totalprice")),
    "bucketed_rows_in": (in_buckets("orders", one_of("o_custkey", 3, 7, 11), clean("o_custkey", "o_totalprice")), clean_sql("orders", "o_custkey", ORDER_KEY, "o_custkey IN (3, 7, 11)", "o_custkey, o_totalprice")),
    "bucketed_rows_ne": (in_buckets("nation", ne("n_regionkey", 1), clean("n_name"), 16), clean_sql("nation", "n_regionkey", "n_nationkey", "n_regionkey <> 1", "n_name")),
    "collided_count": (in_buckets("orders", one_of("o_custkey", 3, 7, 11), lambda rows, _: bucketed.collided(rows)), f"SELECT count(*) AS collided FROM ({presence_sql('orders', 'o_custkey', ORDER_KEY, 'o_custkey IN (3, 7, 11)')}) WHERE cnt > 1"),
    "bucketed_count": (in_buckets("orders", one_of("o_custkey", 3, 7, 11), lambda rows, _: bucketed.bucketed_count(rows)), "SELECT count(*) AS count_star FROM orders WHERE o_custkey IN (3, 7, 11)"),
    "shard_owner_counts": (owner_counts, f"{owner_sql('customer', 'c_custkey')} SELECT owner, count(*) AS rows FROM owned GROUP BY owner"),
    "shard_combine_count": (shard_combine_count, "SELECT count(*) AS count_star FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "shard_presence": (shard_presence, f"{owner_sql('orders', ORDER_KEY)} SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS cnt FROM (SELECT (({mix16('o_custkey')}) + row_number() OVER (PARTITION BY owner ORDER BY o_orderkey) - 1) % 16 AS bucket FROM owned WHERE o_custkey = 7) GROUP BY bucket"),
    **{f"ext_{name}": (looked_up("orders", "o_custkey", "o_totalprice", where=compare("o_custkey", op, 10), strict=False, limit=None), f"SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey {op} 10") for name, op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))},
    "ext_between": (looked_up("orders", "o_custkey", "o_totalprice", where=compare("o_custkey", "between", 5, 9), strict=False, limit=None), "SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 5 AND 9"),
    "ext_like": (looked_up("part", "p_name", "p_brand", where=compare("p_name", "like", "%blue%"), strict=False, limit=None), "SELECT p_name, p_brand FROM part WHERE p_name LIKE '%blue%'"),
    "ext_and": (looked_up("orders", "o_custkey", "o_totalprice", where=both(eq("o_orderstatus", "F"), eq("o_orderpriority", "5-LOW")), strict=False, limit=None), "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'"),
    "ext_or_cross": (looked_up("orders", "o_custkey", "o_totalprice", where=either(eq("o_orderstatus", "P"), eq("o_orderpriority", "5-LOW")), strict=False, limit=None), "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'"),
    "ext_nested": (looked_up("orders", "o_custkey", "o_totalprice", where=either(eq("o_custkey", 7), both(eq("o_orderstatus", "P"), eq("o_orderpriority", "5-LOW"))), strict=False, limit=None), "SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"),
    "record_size": (record_sizes, "SELECT c_custkey, CAST(2 + octet_length(encode(c_name)) + 8 + 8 + 2 + octet_length(encode(c_mktsegment)) AS BIGINT) AS record_bytes FROM customer"),
    "json_payload": (looked_up("events", "value", "props", where=eq("event_type", "click"), limit=None), "SELECT value, props FROM events WHERE event_type = 'click'"),
    "epochs_over_time": (epochs_over_time, "SELECT 1::BIGINT AS version, n_name FROM nation UNION ALL SELECT 2, n_name FROM nation UNION ALL SELECT 2, lower(n_name) FROM nation UNION ALL SELECT 3, n_name FROM nation WHERE n_regionkey = 1"),
    "describe_table": (describe_table, "SELECT * FROM (VALUES (0, 'n_nationkey', 'int', 'key'), (1, 'n_name', 'text', 'index'), (2, 'n_regionkey', 'int', 'index')) AS v(position, name, type, role)"),
    "epoch_list": (epoch_list, "SELECT v.version::BIGINT AS version, CASE v.version WHEN 1 THEN n WHEN 3 THEN 2 * n ELSE m END::BIGINT AS rows, v.version = 1 AS current FROM (VALUES (1), (3), (4)) AS v(version), (SELECT count(*) AS n, count(*) FILTER (n_regionkey = 1) AS m FROM nation)"),
    "csv_round_trip": (csv_round_trip, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"),
    "streamed_events": (streamed_events, "SELECT event_type, count(*) AS count_star FROM events GROUP BY event_type"),
}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query: the BUILDING customers with the largest balances."""
    return looked_up("customer", "c_name", "c_acctbal", where=eq("c_mktsegment", "BUILDING"), order_by=(("c_acctbal", "desc"),))(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
