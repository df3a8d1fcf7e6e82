"""Names that clash with no column, and the folder that all machines share."""

from types import SimpleNamespace

import pytest
from hushtable.errors import FailedPrecondition
from hushtable.names import fresh, scratch, shared_dir


def session(master, **conf):
    at = []
    context = SimpleNamespace(master=master, setCheckpointDir=at.append, getCheckpointDir=lambda: at[-1] if at else None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_shared_dir():
    conf = {"spark.checkpoint.dir": "hdfs:///shared/", "spark.sql.warehouse.dir": "/w"}
    assert shared_dir(session("spark://host:7077", **conf)) == "hdfs:///shared" and scratch(session("yarn", **conf), "x").startswith("hdfs:///shared/x-")
    assert shared_dir(session("local[4]", **{"spark.sql.warehouse.dir": "/w/"})) == "/w/_scratch"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(FailedPrecondition):
            shared_dir(session(master, **{"spark.sql.warehouse.dir": "/w"}))


def test_fresh(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, _A int, b int")
    assert fresh(df, "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]
