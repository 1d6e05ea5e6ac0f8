"""Streaming ingest of changes into a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factlake.sources import log as G


def ingest(changes: DataFrame, path: str, checkpoint: str, width: int | None = None, **trigger) -> StreamingQuery:
    """Write a stream of changes (n, op, id, payload, at, by, vector if facts have one of this width) to a log, one batch folder each. A batch that is run again after a failure
    overwrites its own folder, so every change is in the log once. A log has one writer: either this stream or log.append()."""

    def put(batch: DataFrame, number: int) -> None:
        G.write_batch(batch, path, number, width)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
