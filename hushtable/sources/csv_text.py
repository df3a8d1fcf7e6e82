"""CSV as plain text: a header names the columns, cells are split at commas without quotes and trimmed of ASCII white space, blank lines are skipped.

Every value is checked: a missing column, a line with a wrong number of cells,
a bad number or JSON text, or a record that is too long fails the load and
names a line. Several files are read as one text in the order of their names:
the first one begins with the header. Columns may have any name.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import InvalidArgument
from ..functions.codewords import is_json, record_bytes
from ..plans.schema import SPARK_TYPES, Kind, TableSchema
from ..shipping import ship

INT, REAL = r"^[+-]?\d{1,19}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITE = " \t\n\x0b\x0c\r"


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def read_lines(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The header, and the other lines that aren't blank as ``line`` and ``rid``, their order."""
    text = spark.read.option("lineSep", "\n").text
    lines = text(path)
    files = sorted(lines.inputFiles())
    first = next((row for f in files if (row := text(unquote(f)).first())), None)
    if first is None:
        raise InvalidArgument("a CSV file starts with a header")
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    lines = lines.select(F.col("value").alias("line"), *(c.alias(n) for c, n in zip(place, ("file", "block"), strict=True)), F.monotonically_increasing_id().alias("at"))
    if len(files) > 1:  # Spark deals files by size, so their lines are put in order
        lines = lines.repartitionByRange("file", "block", "at").sortWithinPartitions("file", "block", "at")
    lines = lines.select("line", F.monotonically_increasing_id().alias("rid"))  # the header is 0
    return first["value"], lines.where((F.col("rid") != 0) & (trimmed(F.col("line")) != ""))


def read_csv(spark: SparkSession, path: str, schema: TableSchema, most_bytes: int | None = None) -> DataFrame:
    """The declared columns, typed, and ``rid``, the order of the lines."""
    ship(spark)
    head, lines = read_lines(spark, path)
    names = [n.strip(WHITE) for n in head.strip(WHITE).split(",")]
    if missing := [c.name for c in schema.columns if c.name not in names]:
        raise InvalidArgument(f"the CSV file has no column {missing[0]}")
    if any(c.name.lower() == "rid" for c in schema.columns):
        raise InvalidArgument("rid is the storage order and no name of a column")
    cells = lines.withColumn("cells", F.split("line", ",", -1))
    # all that is not a declared column stays in one struct, whose name none has
    own = next(n for k in range(len(schema.columns) + 1) if (n := f"{'_' * k}own") not in {c.name.lower() for c in schema.columns})
    raw = [trimmed(F.get("cells", F.lit(names.index(c.name)))).alias(c.name) for c in schema.columns]
    rows = cells.select(F.struct("rid", "line", F.size("cells").alias("n")).alias(own), *raw)
    return typed(rows, schema, own, len(names), most_bytes)


def typed(rows: DataFrame, schema: TableSchema, own: str, n_cells: int, most_bytes: int | None) -> DataFrame:
    tests = [(F.col(own)["n"] != n_cells, f"not {n_cells} cells")]
    for c in schema.columns:
        if c.kind is Kind.INT:
            tests.append((~F.col(c.name).rlike(INT) | F.expr(f"try_cast(`{c.name}` as bigint)").isNull(), f"{c.name} is not an integer"))
        elif c.kind is Kind.REAL:
            tests.append((~F.col(c.name).rlike(REAL), f"{c.name} is not a number"))
        elif c.kind is Kind.JSON:
            tests.append((~is_json(c.name), f"{c.name} is not JSON"))
    if most_bytes:
        tests.append((record_bytes(schema) > most_bytes, "the record is too long"))
    fault = F.coalesce(*(F.when(F.coalesce(t, F.lit(True)), F.lit(what)) for t, what in tests))
    if bad := rows.select(fault.alias("fault"), F.col(own)["line"].alias("line"), F.col(own)["rid"].alias("rid")).where("fault is not null").orderBy("rid").limit(1).collect():
        raise InvalidArgument(f"{bad[0]['fault']}: {bad[0]['line'][:200]!r}")
    return rows.select(*(F.col(c.name).cast(SPARK_TYPES[c.kind]).alias(c.name) for c in schema.columns), F.col(own)["rid"].alias("rid"))


def from_rows(spark: SparkSession, schema: TableSchema, rows: list[tuple]) -> DataFrame:
    """Rows of Python values in the order of the columns."""
    numbered = [(*row, i) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, schema.struct().add("rid", "long", False))


def with_rid(df: DataFrame, order: str | None = None) -> DataFrame:
    """An existing table with its storage order: that of a column, or of Spark's scan."""
    return df.withColumn("rid", F.monotonically_increasing_id() if order is None else F.col(order).cast("long"))
