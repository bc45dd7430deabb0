"""Matching of written messages with their deliveries, batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import WAIT_SECONDS


def first_delivery(deliveries: DataFrame, key: str = "id", order: str = "log_offset") -> DataFrame:
    """The earliest delivery of each id; later ones change nothing.

    A minimum over structs combines on the map side, so an id that is redelivered
    without end still sends one row per task. Ties are settled by the other columns.
    """
    rest = [c for c in deliveries.columns if c not in (key, order)]
    return (
        deliveries.groupBy(key)
        .agg(F.min(F.struct(order, *rest)).alias("_first"))
        .select(key, "_first.*")
        .select(deliveries.columns)
    )


def within_wait(written: Column, delivered: Column, seconds: int = WAIT_SECONDS) -> Column:
    return delivered.between(written, written + F.expr(f"interval '{int(seconds)}' second"))


def delivery_match(messages: DataFrame, first: DataFrame, seconds: int = WAIT_SECONDS) -> DataFrame:
    """Writes that met their delivery in time, with the columns of the delivery."""
    m, d = messages.alias("m"), first.alias("d")
    return m.join(
        d,
        (F.col("m.id") == F.col("d.id"))
        & within_wait(F.col("m.created_at"), F.col("d.delivered_at"), seconds),
    ).select("d.id", "d.content", "d.created_at", "d.delivered_at")


def undelivered(messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Writes no event ever arrived for."""
    return messages.join(deliveries.select("id").distinct(), "id", "left_anti")


def orphan_deliveries(messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """First deliveries of ids that nobody wrote.

    Ids are combined and matched first; of the deliveries only those of the ids that are left
    are looked at in full.
    """
    lone = deliveries.select("id").where("id is not null").distinct().join(messages.select("id"), "id", "left_anti")
    return first_delivery(deliveries.join(lone, "id", "left_semi"))


def classify(written: Column, delivered: Column, seconds: int = WAIT_SECONDS) -> Column:
    return (
        F.when(written.isNull(), "orphan")
        .when(delivered.isNull(), "pending")
        .when(within_wait(written, delivered, seconds), "confirmed")
        .otherwise("late")
    )


def delivery_status(messages: DataFrame, deliveries: DataFrame, seconds: int = WAIT_SECONDS) -> DataFrame:
    """confirmed, late, pending or orphan for every id on either side.

    A full outer match as one aggregate over both sides: a full outer join cannot split
    an id that fills a partition, the aggregate combines it before the shuffle. The
    buffers are fixed-width, so it hashes and sorts nothing.
    """
    written = messages.select("id", F.col("created_at").alias("written_at"))
    arrived = deliveries.select("id", "delivered_at", "log_offset")
    both = written.unionByName(arrived, allowMissingColumns=True)
    return both.groupBy("id").agg(
        F.min("written_at").alias("written_at"),
        F.min_by("delivered_at", "log_offset").alias("delivered_at"),
    ).select(
        "id",
        classify(F.col("written_at"), F.col("delivered_at"), seconds).alias("status"),
        "written_at",
        "delivered_at",
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("ids"))


def merge_producers(*records: DataFrame) -> DataFrame:
    """One topic fed by several producers."""
    return reduce(lambda a, b: a.unionByName(b), records)
