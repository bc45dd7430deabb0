"""Open outbox rows as a queue by due time: sorted segments that are written once.

Rows that come in together are sorted by (due time, id) and cut into segments of bounded size,
each a folder of its own. A segment is taken from the front only, so one position says what
is left of it; a segment of which nothing is left is forgotten. The list of live segments is
kept with the commit markers: a marker holds what its batch changed, every so often the whole
list. A poll therefore reads the segments that hold the rows due first, and writes what it
changed, whatever the number of open rows.

The list has a row per segment, or per poll with failed tries; many small segments are merged.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import OPEN, OUTBOX
from ..sinks.batches import BatchStore

SEGMENT_ROWS = 10_000
MOST_SMALL = 64  # small segments that may be live before they are merged
WHOLE_EVERY = 64  # batches between two markers with the whole list

OPEN_ROWS, CHANGES = "open", "changes"


def micros(moment: datetime) -> int:
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return round((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


@dataclass(frozen=True)
class Segment:
    """Rows of one folder in order of (due, id), in microseconds; those up to `at` are taken."""

    table: str
    batch: int
    number: int  # -1: the open rows among all of the folder's
    rows: int  # left
    low: int  # no row left is due before
    high: int  # no row is due after
    at: tuple[int, str] | None = None

    @property
    def key(self) -> str:
        return f"{self.table}/{self.batch}/{self.number}"

    def read(self, spark: SparkSession, store: BatchStore) -> DataFrame:
        path = f"{store.root}/{self.table}/batch_id={self.batch}"
        rows = spark.read.schema(OUTBOX).parquet(path if self.number < 0 else f"{path}/segment={self.number}")
        rows = rows.where(F.col("status") == OPEN)
        if self.at:
            due, id_ = F.timestamp_micros(F.lit(self.at[0])), F.lit(self.at[1])
            rows = rows.where((F.col("next_retry_at") > due) | ((F.col("next_retry_at") == due) & (F.col("id") > id_)))
        return rows.select(*OUTBOX.fieldNames(), F.lit(self.key).alias("_segment"))


class DueQueue:
    """The live segments after a batch of a store."""

    def __init__(self, store: BatchStore, segments: dict[str, Segment], batch: int, whole: int):
        self.store, self.segments, self.batch, self.whole = store, segments, batch, whole
        self._changed: dict[str, Segment | None] = {}

    @classmethod
    def after(cls, store: BatchStore, batch: int) -> DueQueue:
        """From the markers: the last whole list up to the batch, and the changes since."""
        if batch < 0:
            return cls(store, {}, -1, -1)
        last = store.facts(batch)
        segments: dict[str, Segment] = {}
        for b in range(last["whole"], batch + 1):
            for key, s in (last if b == batch else store.facts(b))["segments"].items():
                if s is None:
                    segments.pop(key, None)
                else:
                    segments[key] = Segment(**{**s, "at": tuple(s["at"]) if s["at"] else None})
        return cls(store, segments, batch, last["whole"])

    def _set(self, segment: Segment) -> None:
        gone = segment.rows <= 0
        self._changed[segment.key] = None if gone else segment
        if gone:
            self.segments.pop(segment.key, None)
        else:
            self.segments[segment.key] = segment

    def facts(self, batch: int) -> dict:
        """What the marker of a batch says of the queue; the queue goes on from there."""
        if self.whole < 0 or batch - self.whole >= WHOLE_EVERY:
            self.whole, told = batch, dict(self.segments)
        else:
            told = self._changed
        self._changed, self.batch = {}, batch
        return {"whole": self.whole, "segments": {k: asdict(s) if s else None for k, s in told.items()}}

    def small(self) -> list[Segment]:
        """Segments to be merged, once there are many small ones."""
        few = [s for s in self.segments.values() if s.rows < SEGMENT_ROWS // 2]
        return few if len(few) > MOST_SMALL else []

    def add(self, rows: DataFrame, batch: int, merged: list[Segment] = ()) -> None:
        """Write open rows, and what is left of the merged segments, as new segments."""
        spark = self.store.spark
        parts = [rows.where(F.col("status") == OPEN).select(OUTBOX.fieldNames()), *[s.read(spark, self.store).drop("_segment") for s in merged]]
        every = reduce(DataFrame.unionByName, parts).dropDuplicates(["id", "next_retry_at"])
        path = f"{self.store.root}/{OPEN_ROWS}/batch_id={batch}"
        count = every.count()
        if count:
            ranges = max(1, -(-count // SEGMENT_ROWS))
            cut = every.repartitionByRange(ranges, "next_retry_at", "id").sortWithinPartitions("next_retry_at", "id")
            cut.withColumn("segment", F.spark_partition_id()).write.mode("overwrite").partitionBy("segment").parquet(path)
            written = spark.read.schema(T.StructType([*OUTBOX.fields, T.StructField("segment", T.IntegerType())])).parquet(path)
            due = F.unix_micros("next_retry_at")
            # a row per segment
            for r in written.groupBy("segment").agg(F.count("*").alias("n"), F.min(due).alias("low"), F.max(due).alias("high")).collect():
                self._set(Segment(OPEN_ROWS, batch, r["segment"], r["n"], r["low"], r["high"]))
        for s in merged:
            self._set(replace(s, rows=0))

    def retry(self, batch: int, rows: int, low: int | None, high: int | None) -> None:
        """The rows that a poll left open are a segment as they stand among its changes."""
        if rows:
            self._set(Segment(CHANGES, batch, -1, rows, low, high))

    def due(self, now: datetime, limit: int | None) -> list[Segment]:
        """The segments that hold the first `limit` rows due at a moment."""
        moment = micros(now)
        ready = sorted((s for s in self.segments.values() if s.low <= moment), key=lambda s: s.high)
        horizon, sure = moment, 0
        for s in ready:
            if limit is None or s.high > moment:
                break
            sure += s.rows
            if sure >= limit:
                horizon = s.high
                break
        return [s for s in ready if s.low <= horizon]

    def taken(self, segment: Segment, rows: int, last: tuple[int, str]) -> None:
        self._set(replace(segment, rows=segment.rows - rows, at=last, low=max(segment.low, last[0])))

    def none_due(self, segment: Segment, now: datetime) -> None:
        """What is left of the segment is due later: all that was due has been taken."""
        if segment.key in self.segments:
            left = self.segments[segment.key]
            self._set(replace(left, low=max(left.low, micros(now) + 1)))

    def rows(self) -> DataFrame:
        """All open rows."""
        spark = self.store.spark
        if not self.segments:
            return spark.createDataFrame([], OUTBOX)
        live = spark.createDataFrame(
            [(s.table, s.batch, s.number, *(s.at or (None, None))) for s in self.segments.values()],
            "_table string, _batch long, _number int, _due long, _last string",
        )
        out = []
        for table in {s.table for s in self.segments.values()}:
            place = [T.StructField("batch_id", T.LongType())] + [T.StructField("segment", T.IntegerType())] * (table == OPEN_ROWS)
            rows = spark.read.schema(T.StructType([*OUTBOX.fields, *place])).parquet(f"{self.store.root}/{table}")
            number = F.col("segment") if table == OPEN_ROWS else F.lit(-1)
            due = F.unix_micros("next_retry_at")
            out.append(
                rows.where(F.col("status") == OPEN)
                .join(live, (F.col("_table") == table) & (F.col("batch_id") == F.col("_batch")) & (number == F.col("_number")))
                .where(F.col("_due").isNull() | (due > F.col("_due")) | ((due == F.col("_due")) & (F.col("id") > F.col("_last"))))
                .select(OUTBOX.fieldNames())
            )
        return reduce(DataFrame.unionByName, out)
