"""Load-test metrics over a table of request samples, one run per endpoint."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import trend, trends
from ..schemas import FAILED_RATE_LIMIT, HIDDEN_PATHS

# The statistics a trend reports besides avg, min and max.
TREND_QUANTILES = {"med": 0.5, "p95": 0.95, "p99": 0.99}
CREATED = 201
EXPECTED_STATUS = (200, 399)

_TREND_ORDER = ("avg", "min", "med", "max", "p95", "p99")


def failed() -> Column:
    return ~F.col("status_code").between(*EXPECTED_STATUS)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def ended_at_micros() -> Column:
    """When a request was answered; one without a duration counts from its start alone."""
    return _micros("started_at") + F.coalesce(F.round(F.col("duration_ms") * 1000).cast("long"), F.lit(0))


def _seconds(condition: Column | None = None) -> Column:
    """Time from the first start to the last end; null when there is no such span."""
    start, end = _micros("started_at"), ended_at_micros()
    if condition is not None:
        start, end = F.when(condition, start), F.when(condition, end)
    return F.nullif((F.max(end) - F.min(start)).cast("double") / F.lit(1e6), F.lit(0.0))


def _last_by_time(value: str) -> Column:
    """Value of the latest sample.

    Time and request number are joined into one decimal: a fixed-width order keeps
    the aggregate hash-based, where a struct would make it sort every sample.
    """
    order = _micros("started_at").cast("decimal(18,0)") * F.lit(Decimal(10) ** 19).cast("decimal(20,0)")
    return F.max_by(value, order + F.col("request_id").cast("decimal(19,0)"))


def _named(stats: str) -> list[Column]:
    return [F.col(f"{stats}n").alias("n"), *[F.col(f"{stats}{s}").alias(f"{s}_ms") for s in _TREND_ORDER]]


def latency_trend(requests: DataFrame) -> DataFrame:
    return trend(requests, ["endpoint"], "duration_ms", TREND_QUANTILES).select("endpoint", *_named(""))


def expected_latency(requests: DataFrame) -> DataFrame:
    """The trend over answered requests only."""
    return latency_trend(requests.where(~failed()))


def latency_trends(requests: DataFrame) -> DataFrame:
    """Both trends in one pass: structs `all` and `expected` per endpoint."""
    series = {"all": F.lit(True), "expected": ~failed()}
    stats = trends(requests, ["endpoint"], "duration_ms", TREND_QUANTILES, series)
    return stats.select("endpoint", *[F.struct(*_named(f"{name}.")).alias(name) for name in series])


def run_totals(requests: DataFrame) -> DataFrame:
    """Every metric but the trends, in one pass of fixed-width aggregates.

    The set-up ends with the first request that is not warm-up.
    """
    timed = ~F.col("warmup")
    return requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == CREATED).alias("check_passes"),
        F.count_if(F.col("status_code") != CREATED).alias("check_fails"),
        F.count_if(failed()).alias("failed_requests"),
        F.count_if(timed).alias("iterations"),
        _seconds().alias("run_seconds"),
        _seconds(timed).alias("timed_seconds"),
        ((F.min(F.when(timed, _micros("started_at"))) - F.min(_micros("started_at"))).cast("double") / F.lit(1e6)).alias("setup_seconds"),
        _last_by_time("vus").alias("vus_last"),
        F.min("vus").alias("vus_min"),
        F.max("vus").alias("vus_max"),
    )


def _failed_rate() -> Column:
    return F.col("failed_requests") / F.col("requests")


def check_rate(totals: DataFrame, *keep: str) -> DataFrame:
    """Checks passed and failed, and the failed-request rate.

    In the rate metric a "pass" is a request that failed.
    """
    return totals.select(
        *(keep or ("endpoint", "check_passes", "check_fails")),
        (F.col("check_passes") / F.col("requests")).alias("check_rate"),
        F.col("failed_requests").alias("failed_passes"),
        (F.col("requests") - F.col("failed_requests")).alias("failed_fails"),
        _failed_rate().alias("failed_rate"),
    )


def request_counter(totals: DataFrame) -> DataFrame:
    return totals.select(
        "endpoint", "requests", (F.col("requests") / F.col("run_seconds")).alias("per_second")
    )


def vus_gauge(totals: DataFrame) -> DataFrame:
    return totals.select("endpoint", "vus_last", "vus_min", "vus_max")


def failure_threshold(totals: DataFrame, limit: float = FAILED_RATE_LIMIT) -> DataFrame:
    rate = _failed_rate()
    return totals.select("endpoint", rate.alias("failed_rate"), (rate < F.lit(limit)).alias("ok"))


def net_throughput(totals: DataFrame) -> DataFrame:
    """Iterations per second without the warm-up."""
    return totals.select(
        "endpoint",
        "iterations",
        "timed_seconds",
        (F.col("iterations") / F.col("timed_seconds")).alias("per_second"),
    )


def path_filter(requests: DataFrame, hidden: tuple[str, ...] = HIDDEN_PATHS) -> DataFrame:
    """Drop requests below a hidden path; whole segments, any case."""
    path = F.lower(F.coalesce("path", F.lit("")))
    for prefix in hidden:
        requests = requests.where((path != prefix) & ~path.startswith(prefix + "/"))
    return requests
