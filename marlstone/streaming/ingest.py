"""A stream of (labels, t, v) into a store, each micro-batch once.

The registry is the only state, and it lives in the store: there is no watermark, and late samples
just widen a series' interval. A micro-batch that is run again after a failure finds its id in
the manifest and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Starts the query; with ``available_now`` it ends when what is there has been read."""

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, f"{name}/{number}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": every})).start()
