"""Lookups by value and by bucket over the weather table, request rules, and the registered queries against DuckDB."""

import random

import pytest
from hushtable import queries
from hushtable.errors import InvalidArgument, OutOfRange, Unimplemented
from hushtable.functions import codewords as cw
from hushtable.operators import bucketed, select, shards
from hushtable.plans.lookup import Lookup, both, check, compare, either, eq, ne, one_of
from hushtable.plans.schema import Kind, TableSchema
from hushtable.sources.csv_text import from_rows
from pyspark.sql import functions as F

WEATHER = TableSchema.of("weather", "id INT KEY", "city TEXT INDEX", "country TEXT INDEX", "temperature INT", "humidity INT", "conditions TEXT INDEX")
ROWS = [
    (1, "Amsterdam", "NL", 18, 72, "Cloudy"), (2, "Tokyo", "JP", 27, 61, "Clear"), (3, "Nairobi", "KE", 24, 55, "Sunny"), (4, "Reykjavik", "IS", 9, 80, "Rain"), (5, "Santiago", "CL", 21, 40, "Clear"),
    (6, "Toronto", "CA", 15, 67, "Overcast"), (7, "Cairo", "EG", 33, 30, "Sunny"), (8, "Wellington", "NZ", 13, 75, "Windy"), (9, "London", "GB", 11, 77, "Drizzle"),
]


@pytest.fixture(scope="module")
def weather(spark):
    return from_rows(spark, WEATHER, ROWS).repartition(3).cache()


def values(df, column="city"):
    return [r[column] for r in df.collect()]


def found(weather, *columns, where=None, **window):
    return select.select(weather, Lookup(columns or ("*",), where, **window), WEATHER, "rid")


def test_by_value(weather):
    assert values(found(weather, "city", where=eq("conditions", "Sunny"))) == ["Nairobi", "Cairo"]
    assert values(found(weather, "city", where=eq("id", 4))) == ["Reykjavik"]
    assert values(found(weather, "city", where=ne("conditions", "Sunny"), limit=3)) == ["Amsterdam", "Tokyo", "Reykjavik"]
    assert values(found(weather, "city", where=one_of("city", "Cairo", "Tokyo", "Cairo"))) == ["Tokyo", "Cairo"]
    assert values(found(weather, "city", where=either(eq("city", "Cairo"), eq("city", "Oslo")))) == ["Cairo"]
    assert values(found(weather, "city", where=eq("city", "Atlantis"))) == []
    assert found(weather).columns == ["city", "country", "temperature", "humidity", "conditions"]


def test_presentation(weather):
    assert values(found(weather, "city", order_by=(("temperature", "desc"),), limit=3)) == ["Cairo", "Tokyo", "Nairobi"]
    assert values(found(weather, "country", distinct=True, order_by=("country",), limit=4), "country") == ["CA", "CL", "EG", "GB"]
    assert values(found(weather, ("city", "where"), offset=7), "where") == ["Wellington", "London"]
    assert values(found(weather, "conditions", distinct=True, order_by=("temperature",), limit=4), "conditions") == ["Rain", "Drizzle", "Windy", "Overcast"]
    assert sorted(values(found(weather, "city", limit=None))) == sorted(r[1] for r in ROWS)
    assert len(values(found(weather, "city", limit=100))) == 9 and select.count(weather, WEATHER, ne("conditions", "Sunny")).first()[0] == 7


def test_predicates_reach_the_scan(spark):
    df, schema = queries.opened(spark, "/root/testdata/sf0.001", "customer")
    plan = select.select(df, Lookup(("c_name",), one_of("c_mktsegment", "BUILDING", "MACHINERY")), schema)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(c_mktsegment" in plan and "c_acctbal" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize(
    ("request_", "error"),
    [
        (Lookup(("id",)), Unimplemented), (Lookup(("nope",)), InvalidArgument), (Lookup(("City",)), InvalidArgument), (Lookup(limit=0), InvalidArgument), (Lookup(offset=-1), InvalidArgument),
        (Lookup(order_by=("id",)), Unimplemented), (Lookup(("city", "city"), eq("city", "x")), InvalidArgument), (Lookup(where=eq("temperature", 3)), InvalidArgument),
        (Lookup(where=eq("city", 3)), InvalidArgument), (Lookup(where=eq("id", "3")), InvalidArgument), (Lookup(where=compare("city", "like", "a%")), Unimplemented),
        (Lookup(where=compare("id", "<", 3)), Unimplemented), (Lookup(where=compare("id", "between", 3, 4)), Unimplemented), (Lookup(where=both(eq("id", 1), eq("city", "x"))), Unimplemented),
        (Lookup(where=either(eq("id", 1), eq("city", "x"))), Unimplemented), (Lookup(where=one_of("id", *range(65))), InvalidArgument), (Lookup(where=one_of("id")), InvalidArgument),
    ],
)
def test_refused_requests(request_, error):
    with pytest.raises(error):
        check(request_, WEATHER)


def test_extensions(weather):
    run = lambda where: values(select.select(weather, Lookup(("city",), where), WEATHER, "rid", strict=False))
    assert run(both(compare("temperature", ">", 20), compare("city", "like", "%i%"))) == ["Nairobi", "Santiago", "Cairo"]
    assert run(either(compare("id", "between", 1, 2), eq("country", "GB"))) == ["Amsterdam", "Tokyo", "London"]
    assert check(Lookup(("city", "city")), WEATHER) is None  # a scan may repeat a column


def test_schema_rules():
    for bad in (["a INT"], ["a INT KEY", "b INT KEY"], ["a REAL KEY"], ["a INT KEY", "b JSON INDEX"], ["a INT KEY", "a TEXT"], ["a BOOL KEY"], ["a INT KEY", "b TEXT SORTED"], []):
        with pytest.raises(InvalidArgument):
            TableSchema.of("t", *bad)
    assert WEATHER.key.name == "id" and TableSchema.from_json("weather", WEATHER.to_json()) == WEATHER
    assert WEATHER.struct()["city"].metadata == {"role": "index", "kind": "text"}


CODEWORDS = {"Cloudy": (22341, 13), "Clear": (25346, 7), "Sunny": (27532, 1), "Rain": (50483, 0), "Tokyo": (38297, 4), "Nairobi": (45273, 0), "Toronto": (14166, 10), "Cairo": (60923, 10)}


def test_codewords(spark):
    for text, (code, bucket) in CODEWORDS.items():
        assert cw.text_codeword(text) == code and cw.mix(code) % 16 == bucket
    rng = random.Random(1)
    rows = [("".join(rng.choice("aé日😀 z") for _ in range(rng.randint(0, 12))),) for _ in range(50)] + [(t,) for t in CODEWORDS]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", cw.codeword("t", Kind.TEXT).alias("c"), cw.codeword("t", Kind.TEXT, 32).alias("d")).withColumn("b", cw.first_bucket(F.col("d"))).collect()
    assert all(r["c"] == cw.text_codeword(r["t"]) and r["d"] == cw.text_codeword(r["t"], 32) and r["b"] == cw.mix(r["d"]) % 16 for r in got)
    with pytest.raises(OutOfRange):
        cw.codeword_of(-1)
    with pytest.raises(Exception, match="no codeword"):
        spark.range(70_000, 70_001).select(cw.codeword("id", Kind.INT)).collect()


@pytest.mark.parametrize(
    ("where", "clean", "n_collided", "n"),
    [
        (eq("conditions", "Sunny"), ["Nairobi", "Cairo"], 0, 2), (one_of("city", "Tokyo", "Cairo", "London"), ["London", "Tokyo", "Cairo"], 0, 3), (either(eq("city", "Tokyo"), eq("city", "Nairobi")), ["Nairobi", "Tokyo"], 0, 2),
        (ne("conditions", "Sunny"), ["Reykjavik", "Wellington", "Tokyo", "Santiago", "London", "Amsterdam", "Toronto"], 0, 7), (eq("conditions", "Clear"), ["Tokyo", "Santiago"], 0, 2),
        (one_of("id", 1, 5, 9), ["Amsterdam", "London", "Santiago"], 0, 3), (eq("city", "Atlantis"), [], 0, 0), (one_of("city", "Toronto", "Cairo"), [], 1, 2), (one_of("id", 4, 5), [], 1, 2),
        (one_of("conditions", "Windy", "Sunny"), ["Cairo"], 1, 3), (ne("conditions", "Clear"), ["Reykjavik", "Cairo", "London", "Amsterdam", "Toronto"], 1, 7),
        (ne("id", 1), ["Toronto", "London", "Wellington", "Cairo", "Nairobi", "Tokyo"], 1, 8),
    ],
)
def test_buckets(weather, where, clean, n_collided, n):
    rows = bucketed.matching(weather, WEATHER, where)
    assert values(bucketed.clean_rows(rows, "rid").orderBy("bucket")) == clean
    assert bucketed.collided(rows).first()[0] == n_collided and bucketed.bucketed_count(rows).first()[0] == n


def test_buckets_against_the_definition(spark):
    """Hot and cold codewords, several shards: presence, clean rows and assignment row by row."""
    schema = TableSchema.of("t", "k INT KEY", "v INT")
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 0, 0, *range(1, 40)]), i) for i in range(400)]
    df = from_rows(spark, schema, rows).repartition(5)
    shard = F.when(F.col("v") % 3 == 0, "a").otherwise("b")
    for where in (eq("k", 0), one_of("k", *range(1, 9)), ne("k", 0)):
        wanted = [(i, k, v) for i, (k, v) in enumerate(rows) if (k in where.values) != (where.op == "<>")]
        seen, place = {}, {}
        for i, k, v in wanted:
            s = "a" if v % 3 == 0 else "b"
            place[i] = (cw.mix(k) + seen.get((s, k), 0)) % 8
            seen[s, k] = seen.get((s, k), 0) + 1
        counts = {b: list(place.values()).count(b) for b in set(place.values())}
        got = bucketed.matching(df, schema, where, shard=shard)
        assert {r["bucket"]: r["cnt"] for r in bucketed.presence(got, 8).collect()} == counts
        assert {r["rid"]: r["bucket"] for r in bucketed.clean_rows(got, "rid", 8).collect()} == {i: b for i, b in place.items() if counts[b] == 1}
        assert {r["rid"]: r["bucket"] for r in bucketed.assigned(got, "rid", 8, block=50).collect()} == place
    with pytest.raises(InvalidArgument):
        bucketed.presence(got, 12)


def test_ring(spark):
    points, owners = cw.ring(["n1", "n2", "n3", "n4"])
    keys = [f"k{i}" for i in range(1000)]
    here = {k: cw.ring_owner(k, points, owners) for k in keys}
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", cw.owner(F.col("k"), ["n4", "n1", "n2", "n3"]).alias("o")).collect()
    assert {r["k"]: r["o"] for r in got} == here and set(here.values()) == {"n1", "n2", "n3", "n4"}
    assert cw.shard_map_text(["n3", "n1", "n3"]) == "n1\nn3" and cw.shard_map_nodes("n1\n\nn3\n") == ["n1", "n3"]
    fewer = cw.ring(["n1", "n2", "n3"])
    assert all(cw.ring_owner(k, *fewer) == o for k, o in here.items() if o != "n4")  # only the keys of a node that leaves move


def test_shards_cover_the_table(weather):
    nodes = ["a", "b", "c"]
    parts = [shards.owned(weather, WEATHER, nodes, n).count() for n in nodes]
    assert sum(parts) == 9 == sum(r["rows"] for r in shards.owner_counts(weather, WEATHER, nodes).collect())
    assert sum(r["cnt"] for r in shards.presence_by_shard(weather, WEATHER, ne("id", 0), nodes, 16).collect()) == 9


def test_record_sizes_and_json(spark):
    schema = TableSchema.of("t", "id INT KEY", "city TEXT", "pop INT", "lat REAL")
    df = spark.createDataFrame([(1, "London", 8908081, 51.5), (2, "é", 1, 1.0)], "id long, city string, pop long, lat double")
    assert [r[0] for r in df.orderBy("id").select(cw.record_bytes(schema)).collect()] == [24, 20]
    texts = ['{"a":1}', '{"a":1} x', "", "NaN", "[1,2]", None, "{"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cw.is_json("t").alias("ok")).collect()
    assert {r["t"] for r in got if r["ok"]} == {'{"a":1}', "[1,2]"}


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in queries.ROLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    for name, (query, sql) in queries.ALL.items():
        if sql is None or name in ("epochs_over_time", "describe_table", "epoch_list", "csv_round_trip", "streamed_events"):
            continue
        df = query(spark, at)
        relation = con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(relation.columns), name
        got = sorted(str([r[c] for c in columns]) for r in df.collect())
        assert got == sorted(str([r[relation.columns.index(c)] for c in columns]) for r in relation.fetchall()), name
