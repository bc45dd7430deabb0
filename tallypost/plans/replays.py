"""Landing given tables as streams: slices in time order, then records that end the input."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import partial, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import side_by_side, workspace
from ..streaming.run import append_sink, cuts_between, read_sink, replay, slice_between

# Id of the records that only move the watermark past the last real one, unless the caller has a free one.
_END_ID = -1
_END_GAP = timedelta(days=1)
_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def as_stream_time(df: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP; stored times may be TIMESTAMP_NTZ."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


class Landing:
    """A folder that slices of one table are appended to, and the stream that reads it."""

    def __init__(self, df: DataFrame, arrival: str, root: str):
        self.df, self.arrival, self.path = as_stream_time(df), arrival, root

    def land(self, cuts: list, i: int) -> None:
        """A row without arrival time comes at another of its times: it must not move the watermark ahead."""
        times = [f.name for f in self.df.schema.fields if f.dataType.typeName() == "timestamp"]
        at = F.coalesce(self.arrival, *(c for c in times if c != self.arrival))
        slice_between(self.df, at, cuts, i).write.mode("append").parquet(self.path)

    def land_end(self, moment, end_id: int = _END_ID) -> None:
        """One record at `moment`; all its times are the same, other columns null."""
        columns = [
            F.lit(end_id).cast(f.dataType).alias(f.name) if f.name == "id"
            else F.lit(moment if f.dataType.typeName() == "timestamp" else None).cast(f.dataType).alias(f.name)
            for f in self.df.schema.fields
        ]
        self.df.sparkSession.range(1).select(*columns).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.df.sparkSession.readStream.schema(self.df.schema).parquet(self.path)


def _free_id(landings: list[Landing], low: int | None, high: int | None) -> int:
    """An id that no row has, given the lowest and the highest."""
    if low is None:
        return _END_ID
    most = 1 << min(_BITS[land.df.schema["id"].dataType.typeName()] for land in landings) - 1
    if low > -most:
        return low - 1
    if high < most - 1:
        return high + 1
    ids = reduce(DataFrame.union, (land.df.select(F.col("id").cast("long").alias("id")) for land in landings)).distinct()
    return ids.where(F.col("id") < most - 1).select((F.col("id") + 1).alias("id")).join(ids, "id", "left_anti").first()["id"]


def run_over(
    spark: SparkSession, label: str, tables: dict[str, tuple[DataFrame, str]],
    build: Callable[..., DataFrame], slices: int = 2, end_gap: timedelta = _END_GAP,
) -> DataFrame:
    """Run `build(**streams)` over the tables in time order and return what it wrote.

    `tables` maps a stream name to (table, arrival column). The stream stops and
    resumes from its checkpoint after every slice. An end record per table follows; it
    moves the watermark, which takes effect in the empty batch Spark runs after it.
    """
    root = workspace(spark, label)
    landings = {name: Landing(df, arrival, f"{root}/in-{name}") for name, (df, arrival) in tables.items()}
    known = sorted(reduce(DataFrame.union, (
        land.df.agg(F.lit(i), F.min(land.arrival), F.max(land.arrival), F.min("id"), F.max("id"))
        for i, land in enumerate(landings.values())
    )).collect())  # in one job, the first table leads
    cuts = cuts_between(*known[0][1:3], slices)
    latest = max((t for _, _, t, _, _ in known if t is not None), default=datetime(1970, 1, 1))
    ids = [(low, high) for *_, low, high in known if low is not None]
    end_id = _free_id([*landings.values()], min((x for x, _ in ids), default=None), max((x for _, x in ids), default=None))

    def slice_step(i: int) -> Callable[[], None]:
        return lambda: side_by_side(spark, (partial(land.land, cuts, i) for land in landings.values()))

    def end_step() -> None:
        side_by_side(spark, (partial(land.land_end, latest + end_gap, end_id) for land in landings.values()))

    steps = [*(slice_step(i) for i in range(len(cuts) + 1)), end_step]
    shape: list[DataFrame] = []

    def writer():
        out = build(**{name: land.stream() for name, land in landings.items()})
        shape[:] = [out]
        return append_sink(out, f"{root}/out", f"{root}/checkpoint")

    replay(steps, writer)
    return read_sink(spark, f"{root}/out", shape[0]).where(~F.col("id").eqNullSafe(end_id))
