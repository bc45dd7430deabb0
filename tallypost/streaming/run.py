"""Running streams over what is available, and feeding them in time order."""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter


def run_available(writer: DataStreamWriter) -> None:
    """Process all input there is, then stop; the checkpoint keeps the position."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def read_sink(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def time_cuts(df: DataFrame, column: str, slices: int) -> list:
    """Inner borders that cut the time range of `df` into equal slices."""
    return cuts_between(*df.agg(F.min(column), F.max(column)).first(), slices)


def cuts_between(low, high, slices: int) -> list:
    """The same between two times; none where there is no time."""
    if low is None:
        return []
    step = (high - low) / slices
    return [low + step * i for i in range(1, slices)]


def slice_between(df: DataFrame, column: str | Column, cuts: list, i: int) -> DataFrame:
    """Slice `i` of `len(cuts) + 1`; the first and last are open-ended, rows without a time are in the first."""
    at = F.col(column) if isinstance(column, str) else column
    if i > 0:
        df = df.where(at >= F.lit(cuts[i - 1]))
    if i < len(cuts):
        before = at < F.lit(cuts[i])
        df = df.where(before | at.isNull() if i == 0 else before)
    return df


def replay(steps: Iterable[Callable[[], None]], writer: Callable[[], DataStreamWriter]) -> None:
    """Land a slice, run the stream to its end, and so on; each run resumes the last."""
    for land in steps:
        land()
        run_available(writer())
