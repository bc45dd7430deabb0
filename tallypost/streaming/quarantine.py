"""Decoded streams in two tables: what could be read, and what could not, as it came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.codec import split_malformed
from ..sinks.batches import BatchStore

GOOD, QUARANTINE = "good", "quarantine"


def split_batch(decoded: DataFrame, batch_id: int, store: BatchStore) -> None:
    """A batch that was split before is left as it is."""
    if store.facts(batch_id):
        return
    decoded.persist()
    try:
        good, bad = split_malformed(decoded)
        store.put(good, GOOD, batch_id)
        store.put(bad, QUARANTINE, batch_id)
        store.commit(batch_id)
    finally:
        decoded.unpersist()


def split_stream(decoded: DataFrame, store: BatchStore, checkpoint: str) -> DataStreamWriter:
    """One bad record stops neither the stream nor its batch."""
    return decoded.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: split_batch(batch, batch_id, store)
    )
