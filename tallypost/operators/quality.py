"""Constraints the tables declare; Spark does not enforce them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def constraint_check(
    df: DataFrame, key: str = "id", not_null: tuple[str, ...] = (), max_length: dict[str, int] | None = None
) -> DataFrame:
    """Violations per constraint, in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (key, *not_null)],
        *[
            F.count_if(F.length(c) > limit).alias(f"too_long_{c}")
            for c, limit in (max_length or {}).items()
        ],
    )
