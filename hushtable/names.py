"""Names and folders that don't clash with those of a table or a machine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import FailedPrecondition


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names with so many underscores before them that no column of the table has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, local mode takes a folder under the warehouse; a cluster is refused."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise FailedPrecondition("spark.checkpoint.dir names no folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
