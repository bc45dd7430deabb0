"""Matching of writes with deliveries on streams.

Two forms, both keyed by id alone and independent of the order in which records come in.
The settled form collects what belongs to an id in a session: records not further apart than
a gap, which must exceed the longest time from a write to its last redelivery. A session is
reported when the watermark has passed its end. The prompt form joins the two streams within
the time bound and reports a write once the watermark has passed its bound.

Repeats are folded before the shuffle: sessions merge on the map side (a setting of the
session, see `session.prepare`), the join's deliveries are thinned per Arrow batch.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.delivery import classify
from ..schemas import WAIT_SECONDS

DELAY = "3 minutes"


def _arrival() -> Column:
    """A record without a time of arrival counts from when its message was written."""
    return F.coalesce("delivered_at", "created_at")


def first_delivery_stream(deliveries: DataFrame, delay: str = DELAY, gap: str | None = None) -> DataFrame:
    """The delivery of each id with the lowest offset, whatever order they arrive in."""
    rest = [c for c in deliveries.columns if c not in ("id", "log_offset")]
    return (
        deliveries.withColumn("_at", _arrival()).withWatermark("_at", delay)
        .groupBy("id", F.session_window("_at", gap or delay))
        .agg(F.min(F.struct("log_offset", *rest)).alias("_first"))
        .select("id", "_first.*")
        .select(deliveries.columns)
    )


# The lowest offset wins; the rest of the struct is what the match reports.
_EVENT = ("log_offset", "delivered_at", "content")


def _event_type(deliveries: DataFrame):
    return deliveries.select(F.struct(*_EVENT).alias("event")).schema["event"].dataType


def delivery_status_stream(
    messages: DataFrame, deliveries: DataFrame, delay: str = DELAY, seconds: int = WAIT_SECONDS, gap: str | None = None
) -> DataFrame:
    """Settled form of first delivery and full outer match in one.

    One aggregate over the union of both sides: a row of state per session, where a stream
    join would buffer both sides. Each side has its own watermark; the slower one counts.
    """
    written = messages.withWatermark("created_at", delay).select(
        "id", F.col("created_at").alias("at"), F.col("created_at").alias("written_at"),
        F.lit(None).cast(_event_type(deliveries)).alias("event"),
    )
    arrived = deliveries.withColumn("at", _arrival()).withWatermark("at", delay).select(
        "id", "at", F.lit(None).cast("timestamp").alias("written_at"),
        F.struct(*_EVENT).alias("event"),
    )
    met = written.union(arrived).groupBy("id", F.session_window("at", gap or delay)).agg(
        F.min("written_at").alias("written_at"), F.min("event").alias("_first")
    )
    return met.select(
        "id",
        classify(F.col("written_at"), F.col("_first.delivered_at"), seconds).alias("status"),
        "written_at",
        F.col("_first.delivered_at").alias("delivered_at"),
        F.col("_first.content").alias("content"),
    )


def union_of_producers(delay: str = DELAY, gap: str | None = None, **producers: DataFrame) -> DataFrame:
    """(producer, id, content, created_at): the first record of each id of each producer, by time sent.

    Every producer has a watermark of its own and the slowest one counts
    (`spark.sql.streaming.multipleWatermarkPolicy`, min by default), so a producer that is
    behind loses nothing.
    """
    sides = [
        df.withWatermark("sent_at", delay).select(F.lit(name).alias("producer"), "id", "content", "created_at", "sent_at")
        for name, df in producers.items()
    ]
    together = sides[0]
    for side in sides[1:]:
        together = together.unionByName(side)
    once = together.groupBy("producer", "id", F.session_window("sent_at", gap or delay)).agg(
        F.min(F.struct("sent_at", "content", "created_at")).alias("_first")
    )
    return once.select("producer", "id", "_first.content", "_first.created_at")


def open_writes(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(id, written_at) of writes that no delivery had met when a status stream stopped.

    Read from the state in its checkpoint, so it says who is waiting now without another
    pass over the data. What the watermark had settled is not there any more.
    """
    state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    # the fields are named by how they are computed; the last two are the write and the first event
    fields = state.schema["value"].dataType.fields
    named = T.StructType([T.StructField(f"v{i - len(fields)}", f.dataType) for i, f in enumerate(fields)])
    key = state.schema["key"].dataType.fieldNames()[0]
    rows = state.select(F.col(f"key.`{key}`").alias("id"), F.col("value").cast(named).alias("value"))
    return rows.where("value.`v-2` is not null and value.`v-1` is null").select("id", F.col("value.`v-2`").alias("written_at"))


def _lowest_in_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        keep = np.zeros(len(ids), bool)
        for column in ("log_offset", "delivered_at"):
            order = np.lexsort((b.column(column).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(), ids))
            first = np.ones(len(order), bool)
            first[1:] = ids[order[1:]] != ids[order[:-1]]
            keep[order[first]] = True
        yield b if keep.all() else b.filter(pa.array(keep))


def thin_repeats(deliveries: DataFrame) -> DataFrame:
    """Of each id in an Arrow batch keep the lowest offset and the earliest arrival, before any shuffle.

    An id with a third of all rows then costs its reducer a row or two per batch.
    """
    return deliveries.mapInArrow(_lowest_in_batch, deliveries.schema)


def rendezvous(
    messages: DataFrame, deliveries: DataFrame, delay: str = DELAY, seconds: int = WAIT_SECONDS
) -> DataFrame:
    """(id, written_at, delivered_at, content) of every write; nulls where its wait ran out.

    The join comes first and takes what arrived within the bound, the lowest offset of that
    is the match: no copy that comes too late can stand in for one that came in time.
    """
    m = messages.withWatermark("created_at", delay).select(
        F.col("id").alias("m_id"), F.col("created_at").alias("written_at")
    )
    d = thin_repeats(deliveries.select("id", *_EVENT)).withWatermark("delivered_at", delay)
    bound: Column = F.col("written_at") + F.expr(f"interval '{int(seconds)}' second")
    joined = m.join(d, (F.col("m_id") == F.col("id")) & F.col("delivered_at").between(F.col("written_at"), bound), "left_outer")
    event = F.when(F.col("id").isNotNull(), F.struct(*_EVENT))
    met = joined.groupBy("m_id", "written_at").agg(F.min(event).alias("_first"))
    return met.select(F.col("m_id").alias("id"), "written_at", "_first.delivered_at", "_first.content")
