"""Structured Streaming into versioned tables: each micro-batch becomes an append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import NotFound
from ..plans.schema import TableSchema
from ..sources.csv_text import with_rid
from ..sources.epochs import Catalog


def stream_name(catalog: Catalog, checkpoint: str) -> str:
    """What tells this stream from others: written into its checkpoint at the first start, so a new checkpoint is a new stream."""
    at = f"{checkpoint.rstrip('/')}/publisher"
    catalog.write_new(at, uuid.uuid4().hex)
    return catalog.text_of(at)


def publish_stream(stream: DataFrame, catalog: Catalog, schema: TableSchema, checkpoint: str, database: str = "default", once: bool = True) -> StreamingQuery:
    """Appends all that is there (``once``) or goes on.

    The commit of a batch records the stream and the batch's number, and only a batch that is recorded is
    skipped: so one that runs again after a failure is there once, whatever else writes to the table.
    """
    name = stream_name(catalog, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        rows = with_rid(batch.select(*(f"`{c.name}`" for c in schema.columns)))
        try:
            catalog.append(rows, schema.table, database, stream=(name, number))
        except NotFound:
            catalog.publish(rows, schema, database, stream=(name, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
