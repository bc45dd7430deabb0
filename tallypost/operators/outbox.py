"""Transactional outbox: rows, state from the attempt log, the next batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codec import JSON_SERIALIZER, Serializer
from ..schemas import DEAD, DONE, OPEN, OUTBOX_BATCH, OUTBOX_MAX_ATTEMPTS, TYPE_NAME


def outbox_id(message_id: Column, type_name: str = TYPE_NAME) -> Column:
    """A uuid made from the message, so that a repeated write gives the same row."""
    digest = F.md5(F.concat_ws(":", F.lit(type_name), message_id.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def outbox_row(messages: DataFrame, serializer: Serializer = JSON_SERIALIZER) -> DataFrame:
    created = F.col("created_at").cast("timestamp")
    return messages.select(
        outbox_id(F.col("id")).alias("id"),
        F.lit(TYPE_NAME).alias("type_name"),
        serializer.encode(F.col("id"), F.col("content"), F.col("created_at")).alias("payload"),
        F.lit(OPEN).alias("status"),
        F.lit(0).alias("retry_count"),
        created.alias("next_retry_at"),
        created.alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit(None).cast("string").alias("dead_letter_error"),
    )


def status_after(done: Column, failures: Column, max_attempts: int = OUTBOX_MAX_ATTEMPTS) -> Column:
    return F.when(done, DONE).when(failures >= max_attempts, DEAD).otherwise(OPEN)


def retry_time(last: Column, failures: Column) -> Column:
    """Wait 2, 4, 8.. seconds after the last try."""
    return last + F.make_dt_interval(secs=F.pow(F.lit(2), failures).cast("decimal(18,6)"))


def partial_state(attempts: DataFrame, key: str = "id") -> DataFrame:
    """What a set of tries says of each row; such states merge, see `merged_state`."""
    return attempts.groupBy(key).agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.bool_or("ok").alias("done"),
        F.max("attempted_at").alias("last_at"),
        F.min(F.when(F.col("ok"), F.col("attempted_at"))).alias("processed_at"),
        F.max(F.when(~F.col("ok"), F.struct("attempt_no", "error"))).alias("failed"),
    )


def merged_state(partials: DataFrame, key: str = "id") -> DataFrame:
    """One state per row from those of sets of tries that share no try."""
    return partials.groupBy(key).agg(
        F.sum("failures").alias("failures"), F.bool_or("done").alias("done"), F.max("last_at").alias("last_at"),
        F.min("processed_at").alias("processed_at"), F.max("failed").alias("failed"),
    )


def finished_state(
    rows: DataFrame, tries: DataFrame, key: str = "id", max_attempts: int = OUTBOX_MAX_ATTEMPTS
) -> DataFrame:
    """State of each outbox row from what its tries say; rows without tries are open."""
    tried = tries.withColumnRenamed("processed_at", "_processed_at")
    failures = F.coalesce(F.col("failures").cast("int"), F.lit(0))
    status = status_after(F.coalesce("done", F.lit(False)), failures, max_attempts)
    due = F.when(F.col("last_at").isNull(), F.col("created_at")).otherwise(retry_time(F.col("last_at"), failures))
    return rows.select(key, "created_at").join(tried, key, "left").select(
        key,
        status.alias("status"),
        failures.alias("retry_count"),
        due.alias("next_retry_at"),
        "created_at",
        F.col("_processed_at").alias("processed_at"),
        F.when(status == DEAD, F.col("failed.error")).alias("dead_letter_error"),
    )


def outbox_state(
    rows: DataFrame, attempts: DataFrame, key: str = "id", max_attempts: int = OUTBOX_MAX_ATTEMPTS
) -> DataFrame:
    """State of each outbox row from the append-only log of tries."""
    return finished_state(rows, partial_state(attempts, key), key, max_attempts)


def outbox_batch(
    state: DataFrame, now: Column, limit: int | None = OUTBOX_BATCH, key: str = "id"
) -> DataFrame:
    """Open rows that are due, oldest first; without a limit, all of them."""
    due = state.where((F.col("status") == OPEN) & (F.col("next_retry_at") <= now))
    return due if limit is None else due.orderBy("next_retry_at", key).limit(limit)
