"""Streaming pushes and change feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import files
from ..plans.table import StateTable


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that belongs to the checkpoint: batch numbers count from its beginning."""
    path = f"{checkpoint.rstrip('/')}/keyloom-stream"
    files.create_text(spark, path, uuid.uuid4().hex)
    return files.read_text(spark, path)


def push_stream(items: DataFrame, table: StateTable, checkpoint: str, query: str | None = None, mode: str = "async", trigger: dict | None = None) -> StreamingQuery:
    """Pushes every micro-batch once: a batch that is delivered again is known by its number, which commits with its rows.

    Numbers are kept apart by ``query``; without one each checkpoint has a name of its own.  When another writer commits
    first, the batch is pushed again on the new version.
    """
    spark = table.spark
    query = query or _stream_id(spark, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        table.refresh().retrying(lambda now: now.push(batch, mode, batch_id=str(number), query=query))

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class SyncFeed:
    """Ships one table's changes to another, from a cursor that is kept with the source; it moves only after the target has committed."""

    def __init__(self, source: StateTable, target: StateTable, after: int = 0, name: str | None = None):
        self.name, self.source, self.target = name or target.root, source, target
        if self.name not in source.sync_targets():
            source.add_sync(self.name, target.root, after)

    @property
    def cursor(self) -> int:
        return self.source.sync_targets()[self.name]["cursor"]

    def step(self) -> int:
        """Ships what changed since the cursor and returns the new one; after a failure the next step begins at the same cursor."""
        self.source = self.source.refresh().notify_sync([self.name])
        self.target = self.target.refresh()
        return self.cursor
