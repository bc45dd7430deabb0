"""From a posted body to a stored message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage, stage_at

# monotonically_increasing_id puts the task number above this bit.
_TASK_BITS = 33


def stamp(bodies: DataFrame, clock: Column | None = None) -> DataFrame:
    """Keep the content only and set the time of writing."""
    now = F.current_timestamp() if clock is None else clock
    return bodies.select("content", now.cast("timestamp").alias("created_at"))


def as_int(number: Column) -> Column:
    """The number as int; one beyond fails in either ANSI mode instead of wrapping round."""
    beyond = F.raise_error(F.concat(F.lit("CAST_OVERFLOW: id beyond the int range: "), number.cast("string"))).cast("int")
    return F.when(number <= (1 << 31) - 1, number.cast("int")).otherwise(beyond)


def numbered(messages: DataFrame, path: str | None = None) -> DataFrame:
    """Number the rows from 0 without gaps, as `_number`.

    Rows keep the task they were read in: each task numbers its own rows, and the
    numbers are shifted by the row counts of the tasks before it. No row is moved,
    so equal rows (one body posted many times) cannot pile up in one task. The
    numbered rows are written out first because two passes read them; at a `path` that
    holds such rows already, those are taken.
    """
    slotted = messages.withColumn("_slot", F.monotonically_increasing_id())
    slots = stage(slotted, "assign-id") if path is None else stage_at(slotted, path)
    task = F.shiftright("_slot", _TASK_BITS)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy(task.alias("_task"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    in_task = F.col("_slot").bitwiseAND((1 << _TASK_BITS) - 1)
    return (
        slots.withColumn("_task", task).join(offsets, "_task")
        .select((in_task + F.col("_offset")).alias("_number"), *messages.columns)
    )


def assign_id(messages: DataFrame, high_water_mark: int = 0) -> DataFrame:
    """Give every row a unique int id above the mark, without gaps; see `numbered`."""
    number = F.col("_number") + F.lit(high_water_mark + 1).cast("long")
    return numbered(messages).select(as_int(number).alias("id"), *messages.columns)
