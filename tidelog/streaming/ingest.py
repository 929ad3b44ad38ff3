"""Structured Streaming into a table: a batch of the log per micro-batch, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..table import KVTable


def ingest(stream: DataFrame, table: KVTable, checkpoint: str, order: str | None = None, compact: bool = False, name: str = "ingest", **trigger) -> StreamingQuery:
    """Append ``key``, ``value`` and ``tomb`` of ``stream``. A micro-batch that is delivered again after a restart changes nothing.

    ``trigger``: as for ``DataStreamWriter.trigger``, by default all that is there now. Arrival order is by micro-batch, and
    within one by ``order``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.put(batch, order=batch[order] if order else None, token=f"{name}-{batch_id}")
        if compact:
            table.compact()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
