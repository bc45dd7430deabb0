"""Exact interpolated quantiles per group, without gathering a group in one task.

Values are counted per distinct value, the counts folded into buckets of fixed
width, and the buckets ranked per group. A quantile's rank then lies in a known
bucket, and only the values of that bucket are ranked. The size of both windows is
bound by the value range and the bucket width, not by the number of rows.

Several series (subsets of the same rows) share the scan and the shuffles: each has
a count of its own next to every value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

UNITS_PER_VALUE = 1_000_000
BUCKET_BITS = 20

# Names of the bucket columns on the side that is joined back.
_CHOSEN = "_chosen_"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _matches(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(_CHOSEN + n)) for n in names])


def _scaled(column: str) -> Column:
    return F.col(column).cast("double") / F.lit(float(UNITS_PER_VALUE))


class _Series:
    """The columns of one series and the ranks its quantiles need."""

    def __init__(self, name: str, probs: dict[str, float]):
        self.name = name
        self.count, self.sum = f"_{name}_c", f"_{name}_s"
        self.low, self.high = f"_{name}_lo", f"_{name}_hi"
        self.before, self.start, self.total = f"_{name}_before", f"_{name}_start", f"_{name}_n"
        self.probs = probs

    def position(self, quantile: str) -> Column:
        return F.lit(float(self.probs[quantile])) * (F.col(self.total) - 1)

    def ranks(self, quantile: str) -> tuple[Column, Column]:
        position = self.position(quantile)
        return F.floor(position).cast("long"), F.ceil(position).cast("long")

    def pick(self, quantile: str, side: str) -> str:
        return f"_{self.name}_{quantile}_{side}"

    def holds(self, rank: Column, start: Column, count: Column) -> Column:
        return (start <= rank) & (rank < start + count)

    def bucket_totals(self) -> list[Column]:
        there = F.col(self.count) > 0
        weighted = F.col("_u").cast("decimal(19,0)") * F.col(self.count).cast("decimal(19,0)")
        return [
            F.sum(self.count).alias(self.count),
            F.sum(weighted).alias(self.sum),
            F.min(F.when(there, F.col("_u"))).alias(self.low),
            F.max(F.when(there, F.col("_u"))).alias(self.high),
        ]

    def group_totals(self, whole: Window, upto: Window) -> list[Column]:
        return [
            F.col(self.count),
            (F.sum(self.count).over(upto) - F.col(self.count)).alias(self.before),
            F.sum(self.count).over(whole).alias(self.total),
            F.sum(self.sum).over(whole).alias(self.sum),
            F.min(self.low).over(whole).alias(self.low),
            F.max(self.high).over(whole).alias(self.high),
        ]

    def wanted(self) -> Column:
        return _any([
            self.holds(rank, F.col(self.before), F.col(self.count))
            for quantile in self.probs for rank in self.ranks(quantile)
        ])

    def picks(self) -> list[Column]:
        return [
            F.max(F.when(self.holds(rank, F.col(self.start), F.col(self.count)), F.col("_u")))
            .alias(self.pick(quantile, side))
            for quantile in self.probs
            for side, rank in zip(("below", "above"), self.ranks(quantile))
        ]

    def quantile(self, quantile: str) -> Column:
        low, high = _scaled(self.pick(quantile, "below")), _scaled(self.pick(quantile, "above"))
        below, above = self.ranks(quantile)
        position = self.position(quantile)
        rest = position - below
        return F.when(rest == 0, low).otherwise((above - position) * low + rest * high)

    def statistics(self) -> Column:
        n = F.col(self.total)
        return F.struct(
            n.alias("n"),
            F.try_divide(_scaled(self.sum), n.cast("double")).alias("avg"),
            _scaled(self.low).alias("min"),
            _scaled(self.high).alias("max"),
            *[self.quantile(q).alias(q) for q in self.probs],
        ).alias(self.name)


def trends(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], series: dict[str, Column]
) -> DataFrame:
    """Per group one struct per series: n, avg, min, max and an entry per quantile in `probs`.

    A series is the rows its condition holds for. Values are taken at one millionth of
    a unit; sums are exact decimals, so results do not depend on how rows are spread.
    """
    all_series = [_Series(name, probs) for name in series]
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.rint(F.col(value) * UNITS_PER_VALUE).cast("long").alias("_u"))
        .agg(*[F.count_if(series[s.name]).alias(s.count) for s in all_series])
        .withColumn("_b", F.shiftright("_u", BUCKET_BITS))
    )
    buckets = counts.groupBy(*group, "_b").agg(*[c for s in all_series for c in s.bucket_totals()])
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = buckets.select(*group, "_b", *[c for s in all_series for c in s.group_totals(whole, upto)])
    chosen = (
        ranked.where(_any([s.wanted() for s in all_series]))
        .drop(*[s.count for s in all_series])
        .withColumnsRenamed({n: _CHOSEN + n for n in [*group, "_b"]})
    )
    inside = (
        Window.partitionBy(*group, "_b").orderBy("_u")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = counts.join(chosen, _matches([*group, "_b"])).withColumns({
        s.start: F.col(s.before) + F.sum(s.count).over(inside) - F.col(s.count) for s in all_series
    })
    totals = [c for s in all_series for c in (s.total, s.sum, s.low, s.high)]
    picked = values.groupBy(*group, *totals).agg(*[c for s in all_series for c in s.picks()])
    return picked.select(*group, *[s.statistics() for s in all_series])


def trend(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The statistics of all rows, as columns."""
    return trends(df, group, value, probs, {"all": F.lit(True)}).select(*group, "all.*")
