"""The routes a message can take, each as one plan from raw records to delivery status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codec import decode_records, parse_message, split_malformed
from ..operators import changes as C, delivery as D
from ..schemas import DONE, WAIT_SECONDS


def topic_deliveries(records: DataFrame) -> DataFrame:
    """Records of the message topic as deliveries; the record time is the arrival."""
    good, _ = split_malformed(decode_records(records))
    return good.select(
        "id", "message.content", "message.created_at",
        F.col("timestamp").alias("delivered_at"), F.col("offset").alias("log_offset"),
    )


def dual_write(messages: DataFrame, records: DataFrame, seconds: int = WAIT_SECONDS) -> DataFrame:
    """Row first, topic record after: what never reached the topic stays pending."""
    arrived = topic_deliveries(records).select("id", "log_offset", "delivered_at")
    return D.delivery_status(messages, arrived, seconds)


def table_only(messages: DataFrame) -> DataFrame:
    """The control case: a stored row is the whole answer, nothing is waited for."""
    return messages.select("id", "content", "created_at")


def outbox(messages: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """A dispatched row delivers the message in its payload; others are still to come or dead.

    `rows` (id, payload) and `state` share the outbox id.
    """
    sent = rows.join(state.where(F.col("status") == DONE).select("id", "processed_at"), "id").select(
        F.explode(F.array(parse_message(F.col("payload").cast("string")))).alias("_parsed"), "processed_at"
    )
    arrived = sent.select(F.col("_parsed.value.id").alias("id"), F.col("processed_at").alias("delivered_at"))
    once = arrived.groupBy("id").agg(F.min("delivered_at").alias("delivered_at"))
    return messages.select("id").join(once, "id", "left").select(
        "id", F.col("delivered_at").isNotNull().alias("delivered"), "delivered_at"
    )


def replication(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """Inserts of the message table, read from the change stream, complete their writes."""
    rows = C.project_by_name(C.table_filter(C.insert_only(changes)), keep=("wal_end",))
    return _completed(messages, rows, "wal_end")


def cdc(messages: DataFrame, log: DataFrame) -> DataFrame:
    """After-images of CDC envelopes complete their writes."""
    rows = C.cdc_after_image(C.drop_tombstones(log))
    return _completed(messages, rows, "log_offset")


def _completed(messages: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Each write with the position of the change that completed it; the log has no arrival time."""
    once = rows.groupBy("id").agg(F.min(order).alias("completed_at"))
    return messages.select("id").join(once, "id", "left").select(
        "id", F.col("completed_at").isNotNull().alias("delivered"), "completed_at"
    )
