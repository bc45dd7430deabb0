"""Posted bodies to stored messages, with or without an outbox row for each."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ingest import assign_id, stamp
from ..operators.outbox import outbox_row
from ..schemas import MESSAGE, OUTBOX
from ..sinks.batches import BatchStore
from ..sinks.ledger import IdLedger

MESSAGES, OUTBOX_ROWS = "messages", "outbox"


def write_batch(
    bodies: DataFrame, batch_id: int, store: BatchStore, clock: Column | None = None,
    outbox: bool = False, produce: Callable[[DataFrame], None] | None = None, writer: tuple[IdLedger, str] | None = None,
) -> None:
    """Store one batch of bodies as messages, all or none of it.

    With `outbox`, the outbox rows become visible by the same commit. With `produce`,
    the stored messages go to a topic after the commit: a failure in between leaves
    messages without an event, which is the gap of a dual write. A batch that is repeated
    after its commit writes nothing; its stored messages are produced again.
    With `writer`, a ledger and the name of this stream, ids are shared with other streams;
    else the stream counts for itself.
    """
    if store.facts(batch_id) is None:
        before = store.facts_before(batch_id)
        mark = before["max_id"] if before else 0
        stamped = stamp(bodies, clock)
        if writer:
            ledger, stream = writer
            store.put(ledger.assign(stamped, stream, batch_id), MESSAGES, batch_id)
        else:
            store.put(assign_id(stamped, mark), MESSAGES, batch_id)
        stored = store.batch(MESSAGES, batch_id, MESSAGE)
        if outbox:
            store.put(outbox_row(stored), OUTBOX_ROWS, batch_id)
        top = stored.agg(F.max("id")).first()[0]
        store.commit(batch_id, max_id=mark if top is None else top)
    if produce:
        produce(store.batch(MESSAGES, batch_id, MESSAGE))


def ingest(
    bodies: DataFrame, store: BatchStore, checkpoint: str, clock: Column | None = None,
    outbox: bool = False, produce: Callable[[DataFrame], None] | None = None, writer: tuple[IdLedger, str] | None = None,
) -> DataStreamWriter:
    return bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, store, clock, outbox, produce, writer)
    )


def stored_messages(store: BatchStore) -> DataFrame:
    return store.table(MESSAGES, MESSAGE)


def stored_outbox(store: BatchStore) -> DataFrame:
    return store.table(OUTBOX_ROWS, OUTBOX)
