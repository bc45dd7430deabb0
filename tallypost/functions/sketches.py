"""Quantiles from stored sketches: one per group and time slice, merged for any range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Size of a sketch; its ranks are off by no more than RANK_ERROR, with far over 99 % certainty.
K = 400
RANK_ERROR = 0.02
_STEP = 3600  # seconds of a slice


def slices(df: DataFrame, group: list[str], value: str, at: str, seconds: int = _STEP, k: int = K) -> DataFrame:
    """(group, slice, sketch) with the start of each slice; rows without a value or time are left out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))
    known = df.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    return known.groupBy(*group, start.alias("slice")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sliced: DataFrame, group: list[str], low: datetime | None = None, high: datetime | None = None) -> DataFrame:
    """(group, slices, n, sketch) over the slices that begin in [low, high)."""
    rows = sliced
    if low is not None:
        rows = rows.where(F.col("slice") >= F.lit(low).cast("timestamp"))
    if high is not None:
        rows = rows.where(F.col("slice") < F.lit(high).cast("timestamp"))
    together = rows.groupBy(*group).agg(F.count("*").alias("slices"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return together.select(*group, "slices", F.kll_sketch_get_n_double("sketch").alias("n"), "sketch")


def quantile(p: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(p))


def rank_bounds(df: DataFrame, group: list[str], value: str, quantiles: DataFrame, names: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """Whether each quantile's true rank is within the error: (group, <name>_ok).

    A value stands for all ranks from that of its first to that of its last occurrence.
    """
    held = df.where(F.col(value).isNotNull()).join(F.broadcast(quantiles), group)
    n = F.count("*")
    checks = []
    for name, p in names.items():
        below, upto = F.count_if(F.col(value) < F.col(name)) / n, F.count_if(F.col(value) <= F.col(name)) / n
        checks.append(((below <= p + error) & (upto >= p - error)).alias(f"{name}_ok"))
    return held.groupBy(*group).agg(*checks)
