"""CSV loads, versioned tables, streaming, the session facade and its gate."""

import pytest
from hushtable import queries
from hushtable.access import ANONYMOUS, Gate, Level, read_tokens
from hushtable.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, PermissionDenied, ResourceExhausted
from hushtable.plans.lookup import eq, one_of
from hushtable.plans.schema import TableSchema
from hushtable.session import Session, named, raw, rendered
from hushtable.sources import epochs
from hushtable.sources.csv_text import from_rows, read_csv
from hushtable.sources.epochs import Catalog
from hushtable.streaming.publish import publish_stream

KV = TableSchema.of("t", "k INT KEY", "v TEXT")
MIXED = TableSchema.of("m", "id INT KEY", "name TEXT INDEX", "x REAL", "j JSON")


def rows(spark, *pairs):
    return from_rows(spark, KV, list(pairs))


def csv(tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    return str(tmp_path / "f.csv")


def test_csv(spark, tmp_path):
    text = 'extra, name ,id,x,j\n a, Ann ,1, 1.5,{"a":1}\n\nb,,2,-3e2,[]\nc,Zoë "q",3,.5,1\n'
    got = read_csv(spark, csv(tmp_path, text), MIXED, 128).orderBy("rid").collect()
    assert [tuple(r)[:4] for r in got] == [(1, "Ann", 1.5, '{"a":1}'), (2, "", -300.0, "[]"), (3, 'Zoë "q"', 0.5, "1")]


@pytest.mark.parametrize("text", ["", "id,name,x\n1,a,1\n", "id,name,x,j\n1,a,1\n", "id,name,x,j\n,a,1,1\n", "id,name,x,j\n1,a,1z,1\n", "id,name,x,j\n1,a,1,{\n", "id,name,x,j\n99999999999999999999,a,1,1\n", f"id,name,x,j\n1,{'a' * 200},1,1\n", "id,name,x,j\n1,a,1,1,9\n"])
def test_bad_csv(spark, tmp_path, text):
    with pytest.raises(InvalidArgument):
        read_csv(spark, csv(tmp_path, text), MIXED, 128)


def test_csv_white_space_and_names(spark, tmp_path):
    """Cells and the header are trimmed of tabs and the like; columns may have names that the reader uses itself."""
    schema = TableSchema.of("w", "value INT KEY", "line TEXT", "n INT", "own TEXT", "cells TEXT", "file TEXT", "_n TEXT")
    text = "\tvalue , line\t,n,own,cells,file,_n\x0c\r\n 1,\ta b\x0b, 2 ,o,c,f,x\r\n\t \r\n2,,\t3,,,,\r\n"
    got = read_csv(spark, csv(tmp_path, text), schema).orderBy("rid").collect()
    assert [tuple(r)[:-1] for r in got] == [(1, "a b", 2, "o", "c", "f", "x"), (2, "", 3, "", "", "", "")]
    with pytest.raises(InvalidArgument, match="rid"):
        read_csv(spark, csv(tmp_path, "rid\n1\n"), TableSchema.of("w", "rid INT KEY"))


def test_csv_of_several_files_keeps_their_order(spark, tmp_path):
    """The first file is the smallest, and Spark would read the largest first."""
    (tmp_path / "many").mkdir()
    for k in range(4):
        lines = [f"{i},v{i}" for i in range(10 ** k, 10 ** (k + 1))] if k else ["k,v", "0,v0"]
        (tmp_path / "many" / f"part-{k}.csv").write_text("\n".join(lines) + "\n")
    got = read_csv(spark, str(tmp_path / "many"), KV).orderBy("rid").collect()
    assert [r["k"] for r in got] == [0, *range(10, 10_000)]


def test_versions(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/base")
    with pytest.raises(NotFound):
        catalog.read("t")
    assert catalog.listed(f"file://{tmp_path}/base") == []  # asking makes nothing
    assert catalog.publish(rows(spark, (1, "one"), (2, "two")), KV) == 1
    assert catalog.append(rows(spark, (3, "three")), "t") == 2
    read = lambda v=None: sorted(r["k"] for r in catalog.read("t", version=v).collect())
    assert read() == [1, 2, 3] and read(1) == [1, 2] and sorted(r["rid"] for r in catalog.read("t").collect()) == [0, 1, 2]
    pinned = catalog.read("t", version=1)
    catalog.rollback("t", 1)
    assert read() == [1, 2]
    assert catalog.publish(rows(spark, (9, "nine")), KV) == 3  # never a number again
    assert read() == [9] and pinned.count() == 2
    with pytest.raises(AlreadyExists):
        catalog.publish(rows(spark, (9, "nine")), KV, version=3)
    with pytest.raises(NotFound):
        catalog.rollback("t", 7)
    assert [(r["version"], r["rows"], r["current"]) for r in catalog.epochs("t").orderBy("version").collect()] == [(1, 2, False), (2, 3, False), (3, 1, True)]
    catalog.rollback("t", 1)
    assert catalog.prune("t", keep=1) == [2] and read() == [1, 2] and read(3) == [9]  # the current version stays
    with pytest.raises(NotFound):
        catalog.read("t", version=2)
    assert [tuple(r) for r in catalog.describe("t").orderBy("position").collect()] == [(0, "k", "int", "key"), (1, "v", "text", "payload")]
    catalog.publish(rows(spark, (1, "x")), KV, "sales")
    assert {tuple(r) for r in catalog.tables().collect()} == {("default", "t"), ("sales", "t")}
    with pytest.raises(InvalidArgument):
        catalog.path("../x")


def test_appends_keep_eight_versions(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/base")
    catalog.publish(rows(spark, (0, "v")), KV)
    for k in range(1, 10):
        catalog.append(rows(spark, (k, "v")), "t")
    assert [r["version"] for r in catalog.epochs("t").orderBy("version").collect()] == list(range(3, 11)) and catalog.read("t").count() == 10


def test_many_appends_are_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(epochs, "FAN_IN", 3)
    monkeypatch.setattr(epochs, "KEPT_ENTRIES", 4)
    catalog = Catalog(spark, f"file://{tmp_path}/base")
    catalog.publish(rows(spark, (0, "v")), KV)
    for k in range(1, 20):
        catalog.append(rows(spark, (k, "v")), "t", keep=2)
    now = catalog.epoch("t")
    assert len(now.folders) <= 8 and max(level for _, level in now.parts) >= 2 and now.rows == 20
    df = catalog.read("t")
    assert {r["k"]: r["rid"] for r in df.collect()} == {k: k for k in range(20)}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert len(catalog.entries("t", "default")) <= 5 and len(catalog.listed(f"{catalog.path('t')}/data")) <= 12


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits after the state was read: the change is made again from the new state."""
    one, two = (Catalog(spark, f"file://{tmp_path}/base") for _ in range(2))
    one.publish(rows(spark, (0, "first")), KV)
    plain, raced = Catalog.written, []

    def slow(self, df, at):
        if self is one and not raced:
            raced.append(two.append(rows(spark, (1, "two")), "t"))
        return plain(self, df, at)

    monkeypatch.setattr(Catalog, "written", slow)
    assert one.append(rows(spark, (2, "one"), (3, "one")), "t") == 3 and raced == [2]
    assert {r["k"]: r["rid"] for r in one.read("t").collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert sorted(r["k"] for r in one.read("t", version=2).collect()) == [0, 1]


STREAMED = TableSchema.of("s", "k INT KEY", "v TEXT")


def streamed(spark, tmp_path, catalog, *numbers, checkpoint="c"):
    """Puts some rows into the stream's folder and publishes what is new."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for k in numbers:
        spark.createDataFrame([(k, f"v{k}")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    publish_stream(stream, catalog, STREAMED, str(tmp_path / checkpoint)).awaitTermination()
    return sorted(r["k"] for r in catalog.read("s").collect())


def test_stream_onto_a_table_with_versions(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/base")
    for k in range(3):
        catalog.publish(from_rows(spark, STREAMED, [(k, "old")]), STREAMED)
    assert streamed(spark, tmp_path, catalog, 10, 11) == [2, 10, 11]
    catalog.append(from_rows(spark, STREAMED, [(5, "insert")]), "s")  # between batches
    assert streamed(spark, tmp_path, catalog, 12) == [2, 5, 10, 11, 12]
    catalog.rollback("s", 3)
    assert streamed(spark, tmp_path, catalog, 13) == [2, 13]
    assert len(catalog.epochs("s").collect()) == 7


def test_stream_batches_that_run_again(spark, tmp_path):
    import shutil

    catalog = Catalog(spark, f"file://{tmp_path}/base")
    assert streamed(spark, tmp_path, catalog, 1) == [1] and streamed(spark, tmp_path, catalog, 2) == [1, 2]
    shutil.rmtree(tmp_path / "c" / "commits")  # as if the stream had failed after the tables' commits
    assert streamed(spark, tmp_path, catalog) == [1, 2]
    assert streamed(spark, tmp_path, catalog, 3) == [1, 2, 3]
    assert streamed(spark, tmp_path, catalog, checkpoint="other") == [1, 1, 2, 2, 3, 3]  # another stream


CLASHING = TableSchema.of("c", "k INT KEY", *(f"{n} TEXT INDEX" for n in ("cw", "shard", "first", "bucket", "s", "c", "n", "own", "at", "_n", "_at", "_block", "_rid", "order0", "before")))


def test_clashing_names(spark, tmp_path):
    """Columns of names that bucketed and exact lookups use on the way."""
    names = CLASHING.returned
    root = Session(spark, f"file://{tmp_path}/base", Gate(read_tokens("root admin r")), "r")
    data = [(k, *(f"{n}{k}" for n in names)) for k in range(4)]
    root.load(CLASHING, spark.createDataFrame(data, CLASHING.struct()), "k")
    for where in (eq("shard", "shard2"), eq("bucket", "bucket2"), eq("k", 2)):
        clean, collided = root.private_lookup("c", where=where)
        assert [tuple(r) for r in clean.collect()] == [data[2][1:]] == [tuple(r) for r in root.lookup("c", where=where).collect()] and collided.first()[0] == 0
    assert [r["own"] for r in root.lookup("c", "own", order_by=(("order0", "desc"),), distinct=True).collect()] == ["own3", "own2", "own1", "own0"]


def test_session(spark, tmp_path):
    at = f"file://{tmp_path}/base"
    tokens = read_tokens("# who\nalice query tok-a\n\nroot admin tok-r # all\n")
    root = Session(spark, at, Gate(tokens), "tok-r")
    root.load_csv(KV, csv(tmp_path, "k,v\n7,a\n7,b\n1,one\n"))
    assert [r["v"] for r in root.lookup("t", "v", where=eq("k", 7)).collect()] == ["a", "b"]
    assert root.insert("t", (8, "eight")) == 2
    assert root.count("t").first()[0] == 4 and root.count("t", version=1).first()[0] == 3
    clean, collided = root.private_lookup("t", where=one_of("k", 7, 8))
    assert sorted(r["v"] for r in clean.collect()) == ["a", "b", "eight"] and collided.first()[0] == 0
    assert root.sql("SELECT v FROM t WHERE k = :k", k=8).first()[0] == "eight"
    assert [r["v"] for r in root.scan("t", 2).collect()] == ["a", "b"]
    assert root.status("t").items() >= {"has_epoch": True, "version": 2, "rows": 4, "auth_mode": "token"}.items() and not root.status("u")["has_epoch"]
    assert rendered(root.lookup("t", ("v", "name"), where=eq("k", 8))) == "name\n-----\neight"
    assert named(root.lookup("t", where=eq("k", 8))) == ["v=eight"] and raw(root.lookup("t", where=eq("k", 8)), KV) == [b"\x05\0eight"]
    assert root.principals() == ["alice", "root"]
    alice = Session(spark, at, Gate(tokens), "tok-a")
    assert alice.count("t", eq("k", 7)).first()[0] == 2


ADMIN_CALLS = {
    "load_csv": lambda s, path: s.load_csv(KV, path), "load": lambda s, path: s.load(KV, rows(s.spark, (1, "x"))), "insert": lambda s, path: s.insert("t", (1, "x")), "sql": lambda s, path: s.sql("SELECT k FROM t"),
    "status": lambda s, path: s.status("t"), "principals": lambda s, path: s.principals(), "epochs": lambda s, path: s.epochs("t"), "rollback": lambda s, path: s.rollback("t", 1),
}
QUERY_CALLS = {
    "lookup": lambda s, path: s.lookup("t", where=eq("k", 7)), "count": lambda s, path: s.count("t"), "private_lookup": lambda s, path: s.private_lookup("t", where=eq("k", 7)),
    "scan": lambda s, path: s.scan("t"), "tables": lambda s, path: s.tables(), "describe": lambda s, path: s.describe("t"),
}


@pytest.mark.parametrize("name", [*ADMIN_CALLS, *QUERY_CALLS])
def test_every_call_keeps_its_role(spark, tmp_path, name):
    at, path = f"file://{tmp_path}/base", csv(tmp_path, "k,v\n7,a\n")
    tokens = read_tokens("alice query q\nroot admin r")
    Catalog(spark, at).publish(read_csv(spark, path, KV), KV)
    call = (ADMIN_CALLS | QUERY_CALLS)[name]
    call(Session(spark, at, Gate(tokens), "r"), path)
    others = [Session(spark, at, Gate(tokens), "q"), Session(spark, at, Gate(insecure=True))]
    for session in others:
        if name in QUERY_CALLS:
            call(session, path)
            continue
        with pytest.raises(PermissionDenied):
            call(session, path)
    for token in ("no", None):
        with pytest.raises(PermissionDenied):
            call(Session(spark, at, Gate(tokens), token), path)


def test_gate():
    now = [100.0]
    with pytest.raises(FailedPrecondition):
        Gate()
    gate = Gate(None, rate=1, burst=2, clock=lambda: now[0], insecure=True)
    assert gate.admit(None, Level.QUERY) == ANONYMOUS
    gate.admit(None, Level.QUERY)
    with pytest.raises(ResourceExhausted):
        gate.admit(None, Level.QUERY)
    now[0] += 1
    gate.admit(None, Level.QUERY)
    with pytest.raises(InvalidArgument):
        read_tokens("alice boss tok")


@pytest.mark.parametrize("name", ["epochs_over_time", "describe_table", "epoch_list", "csv_round_trip", "streamed_events"])
def test_table_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in queries.ROLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    query, sql = queries.ALL[name]
    df, relation = query(spark, "/root/testdata/sf0.001"), con.sql(sql)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert columns == sorted(relation.columns) and got == sorted(str([r[relation.columns.index(c)] for c in columns]) for r in relation.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries()) and all(callable(q) for q in e.queries().values())
