"""Ingestion of a stream of documents into a stored index."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import SearchEngine


def ingest(stream: DataFrame, engine: SearchEngine, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each micro-batch to the index in one commit.  The manifest
    names the last batch, so that one that is played again isn't added twice."""
    store = engine.store

    def add(batch: DataFrame, epoch: int) -> None:
        marks = store.state.get("epochs", {})
        if marks.get(checkpoint, -1) < epoch:
            store.insert(batch, note={"epochs": marks | {checkpoint: epoch}})

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
