"""Outbox polling and dispatch as a stream of outbox rows.

Every micro-batch is a poll: new rows join the queue of open ones, the rows due first are
handed to a dispatcher, and what became of them is stored. Open rows are not rewritten (see
`due_queue`), so a poll costs what it takes, not what is open or was ever sent. A poll with
nothing to do leaves a marker only; a poll that is repeated after its marker does nothing.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from typing import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.codec import JSON_SERIALIZER, Serializer, key_bytes
from ..operators.outbox import outbox_batch, retry_time, status_after
from ..schemas import (
    ATTEMPT, MESSAGE_TOPIC, OPEN, OUTBOX, OUTBOX_BATCH, OUTBOX_MAX_ATTEMPTS, OUTBOX_POLL,
)
from ..sinks.batches import BatchStore
from ..sinks.topics import write_topic
from .due_queue import CHANGES, OPEN_ROWS, DueQueue, Segment

DUE_ROWS, CLOSED_ROWS = "due", "closed"
MOST_HELD = 1000  # rows of a poll that are held in the driver; more are written first
_CHANGE = T.StructType([*OUTBOX.fields, *ATTEMPT.fields[1:]])
_TAKEN = T.StructType([*OUTBOX.fields, T.StructField("_segment", T.StringType())])

NO_OUTCOME = "the dispatcher gave no outcome"
UNREADABLE = "the payload holds no message id"

# Takes due outbox rows and returns (id, ok, error); a row without an outcome counts as
# a failed try, and raising fails them all.
Dispatcher = Callable[[DataFrame], DataFrame]


def topic_dispatcher(
    topic: str = MESSAGE_TOPIC, serializer: Serializer = JSON_SERIALIZER, **sink: str
) -> Dispatcher:
    """Produce the payload of each row, keyed by the id of the message in it.

    The serializer is the one that made the payload. A payload that it cannot read, or whose
    message has no id, is not sent: a failed try.
    """

    def dispatch(due: DataFrame) -> DataFrame:
        read = due.select(
            "id", "payload", "created_at", F.explode(F.array(serializer.decode(F.col("payload")))).alias("_read")
        )
        message_id = F.when(F.col("_read.ok"), F.col("_read.value.id"))
        records = read.where(message_id.isNotNull()).select(
            key_bytes(message_id).alias("key"), F.col("payload").alias("value"), F.col("created_at").alias("timestamp")
        )
        write_topic(records, topic=topic, **sink)
        ok = F.coalesce(message_id.isNotNull(), F.lit(False))
        return read.select("id", ok.alias("ok"), F.when(~ok, F.lit(UNREADABLE)).alias("error"))

    return dispatch


def _outcomes(due: DataFrame, dispatcher: Dispatcher) -> DataFrame:
    try:
        return dispatcher(due)
    except Exception as failure:  # whatever the producer raises is a failed try
        return due.select("id", F.lit(False).alias("ok"), F.lit(str(failure)).alias("error"))


def _one_per_id(outcomes: DataFrame) -> DataFrame:
    """Several outcomes of a row are one: a failure if any failed, else a success."""
    return outcomes.groupBy("id").agg(F.min("ok").alias("ok"), F.max(F.when(~F.col("ok"), F.col("error"))).alias("error"))


def poll(
    rows: DataFrame, batch_id: int, store: BatchStore, dispatcher: Dispatcher,
    clock: Callable[[], datetime] | None = None, limit: int | None = OUTBOX_BATCH,
    max_attempts: int = OUTBOX_MAX_ATTEMPTS, queue: DueQueue | None = None,
) -> DueQueue | None:
    """One poll over the open rows and the rows that came in; safe to repeat.

    Returns the queue as the poll leaves it, for the next one; None if the poll was done before.
    """
    if store.facts(batch_id):
        return None
    columns = OUTBOX.fieldNames()
    moment = clock() if clock else datetime.now(timezone.utc)
    store.facts_before(batch_id)
    store.clear(batch_id, OPEN_ROWS, CHANGES, CLOSED_ROWS, DUE_ROWS)
    if queue is None or queue.batch != batch_id - 1:
        queue = DueQueue.after(store, batch_id - 1)
    # Read several times below; kept, so that the source is not asked again each time.
    fresh = rows.where(F.col("id").isNotNull()).select(columns).persist()
    try:
        small = queue.small()
        if not fresh.isEmpty() or small:
            queue.add(fresh, batch_id, small)
            closed = fresh.where(F.col("status") != OPEN)
            if not closed.isEmpty():
                store.put(closed, CLOSED_ROWS, batch_id)
    finally:
        fresh.unpersist()
    segments = queue.due(moment, limit)
    if segments:
        due = _take(segments, batch_id, store, queue, moment, limit)
        if due is not None:
            _settle(due, dispatcher, batch_id, store, queue, moment, max_attempts)
    store.commit(batch_id, **queue.facts(batch_id))
    return queue


def _take(
    segments: list[Segment], batch_id: int, store: BatchStore, queue: DueQueue, moment: datetime, limit: int | None
) -> DataFrame | None:
    """The rows that are due first, fixed: the dispatcher and the outcome must see the same."""
    now = F.lit(moment).cast("timestamp")
    first = outbox_batch(reduce(DataFrame.unionByName, [s.read(store.spark, store) for s in segments]), now, limit)
    at = F.unix_micros("next_retry_at")
    if limit is not None and limit <= MOST_HELD:
        held = first.toArrow()
        due = store.spark.createDataFrame(held, _TAKEN)
        keys = pa.table({
            "_segment": held["_segment"], "at": pc.cast(held["next_retry_at"], pa.int64()), "id": held["id"],
        }).to_pylist()
        took: dict[str, list[tuple[int, str]]] = {}
        for k in keys:
            took.setdefault(k["_segment"], []).append((k["at"], k["id"]))
        taken = [(key, len(places), max(places)) for key, places in took.items()]
    else:
        store.put(first, DUE_ROWS, batch_id)
        due = store.batch(DUE_ROWS, batch_id, _TAKEN)
        # a row per segment
        groups = due.groupBy("_segment").agg(F.count("*").alias("n"), F.max(F.struct(at.alias("at"), "id")).alias("last")).collect()
        taken = [(r["_segment"], r["n"], (r["last"]["at"], r["last"]["id"])) for r in groups]
    by_key = {s.key: s for s in segments}
    for key, n, last in taken:
        queue.taken(by_key[key], n, last)
    if limit is None or sum(n for _, n, _ in taken) < limit:
        for s in segments:
            queue.none_due(s, moment)
    return due.drop("_segment") if taken else None


def _settle(
    due: DataFrame, dispatcher: Dispatcher, batch_id: int, store: BatchStore, queue: DueQueue, moment: datetime, max_attempts: int
) -> None:
    """Try the due rows and store what became of them; those still open go back to the queue."""
    outcome = _one_per_id(_outcomes(due, dispatcher))
    ok = F.coalesce("ok", F.lit(False))
    tried = due.join(outcome, "id", "left").select(
        *due.columns, (F.col("retry_count") + 1).alias("attempt_no"), F.lit(moment).cast("timestamp").alias("attempted_at"),
        ok.alias("ok"), F.when(F.col("ok").isNull(), F.lit(NO_OUTCOME)).when(~F.col("ok"), F.col("error")).alias("error"),
    )
    store.put(_after(tried, max_attempts), CHANGES, batch_id)
    left = F.col("status") == OPEN
    at = F.when(left, F.unix_micros("next_retry_at"))
    again = store.batch(CHANGES, batch_id, _CHANGE).agg(F.count_if(left).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).first()
    queue.retry(batch_id, again["n"], again["low"], again["high"])


def _after(tried: DataFrame, max_attempts: int) -> DataFrame:
    """Rows as their tries leave them, with the try."""
    failures = F.col("retry_count") + (~F.col("ok")).cast("int")
    status = status_after(F.col("ok"), failures, max_attempts)
    at = F.col("attempted_at")
    return tried.select(
        "id", "type_name", "payload",
        status.alias("status"),
        failures.alias("retry_count"),
        F.when(F.col("ok"), F.col("next_retry_at")).otherwise(retry_time(at, failures)).alias("next_retry_at"),
        "created_at",
        F.when(F.col("ok"), at).alias("processed_at"),
        F.when(~F.col("ok") & (status != OPEN), F.col("error")).alias("dead_letter_error"),
        "attempt_no", "attempted_at", "ok", "error",
    )


def dispatch(
    rows: DataFrame, store: BatchStore, checkpoint: str, dispatcher: Dispatcher,
    clock: Callable[[], datetime] | None = None, limit: int | None = OUTBOX_BATCH,
    max_attempts: int = OUTBOX_MAX_ATTEMPTS,
) -> DataStreamWriter:
    held: list[DueQueue | None] = [None]

    def one(batch: DataFrame, batch_id: int) -> None:
        queue, held[0] = held[0], None  # a failed poll must not leave its queue behind
        held[0] = poll(batch, batch_id, store, dispatcher, clock, limit, max_attempts, queue)

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=OUTBOX_POLL)
        .foreachBatch(one)
    )


def with_ticks(rows: DataFrame, per_second: int = 10) -> DataFrame:
    """Add a clock, so that polls go on and retries fall due without new rows."""
    ticks = rows.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in OUTBOX.fields]
    return rows.select(OUTBOX.fieldNames()).unionByName(ticks.select(*nothing))


def outbox_table(store: BatchStore) -> DataFrame:
    """Current state of every row: those that came closed or were closed, and the open ones."""
    columns = OUTBOX.fieldNames()
    closed = store.table(CHANGES, _CHANGE).where(F.col("status") != OPEN).select(columns)
    came = store.table(CLOSED_ROWS, OUTBOX).select(columns)
    return closed.unionByName(came).unionByName(DueQueue.after(store, store.last_batch()).rows())


def attempt_log(store: BatchStore) -> DataFrame:
    return store.table(CHANGES, _CHANGE).select(ATTEMPT.fieldNames())
