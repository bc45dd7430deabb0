"""Summary report: one JSON document of metrics per run, and its figures as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import metrics as M
from ..schemas import FAILED_RATE_LIMIT

# Metric and statistic names of the report.
_TREND_NAMES = {
    "avg_ms": "avg", "min_ms": "min", "med_ms": "med", "max_ms": "max", "p95_ms": "p(95)", "p99_ms": "p(99)",
}
_DURATION = "http_req_duration"
_EXPECTED = "http_req_duration{expected_response:true}"


def _metric(kind: str, contains: str, values: Column, *more: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(contains).alias("contains"), values.alias("values"), *more)


def _trend(prefix: str) -> Column:
    return _metric("trend", "time", F.struct(*[F.col(f"{prefix}.{c}").alias(n) for c, n in _TREND_NAMES.items()]))


def _rate(rate: str, passes: str, fails: str, *more: Column) -> Column:
    values = F.struct(F.col(rate).alias("rate"), F.col(passes).alias("passes"), F.col(fails).alias("fails"))
    return _metric("rate", "default", values, *more)


def _counter(count: str) -> Column:
    return _metric(
        "counter", "default",
        F.struct(F.col(count).alias("count"), (F.col(count) / F.col("run_seconds")).alias("rate")),
    )


def summary(requests: DataFrame) -> DataFrame:
    """`endpoint`, `state` and `metrics` per run."""
    totals = M.run_totals(requests)
    rates = M.check_rate(totals, "*")
    trends = M.latency_trends(requests).withColumnRenamed("endpoint", "_endpoint")
    joined = rates.join(trends, F.col("endpoint").eqNullSafe(F.col("_endpoint")), "left")
    verdict = F.struct(
        F.struct((F.col("failed_rate") < FAILED_RATE_LIMIT).alias("ok")).alias(f"rate<{FAILED_RATE_LIMIT}")
    ).alias("thresholds")
    return joined.select(
        "endpoint",
        F.struct(
            (F.col("run_seconds") * 1000).alias("testRunDurationMs"),
            F.col("timed_seconds").alias("scenarioSeconds"),
            (F.col("requests") - F.col("iterations")).alias("warmupRequests"),
        ).alias("state"),
        F.struct(
            _trend("all").alias(_DURATION),
            _trend("expected").alias(_EXPECTED),
            _rate("failed_rate", "failed_passes", "failed_fails", verdict).alias("http_req_failed"),
            _rate("check_rate", "check_passes", "check_fails").alias("checks"),
            _metric(
                "trend", "time", F.struct((F.col("setup_seconds") * 1000).alias("avg"))
            ).alias("setup_duration_ms"),
            _counter("requests").alias("http_reqs"),
            _counter("iterations").alias("iterations"),
            _metric(
                "gauge", "default",
                F.struct(
                    F.col("vus_last").alias("value"), F.col("vus_min").alias("min"), F.col("vus_max").alias("max")
                ),
            ).alias("vus"),
        ).alias("metrics"),
    )


def write_summary(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def _fixed(value: Column) -> Column:
    return F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit("n/a"))


def figures(report: DataFrame) -> DataFrame:
    """The figures a reader wants, with two decimals."""
    duration = f"metrics.{_DURATION}.values"
    iterations = F.col("metrics.iterations.values.count")
    return report.select(
        "endpoint",
        F.col("metrics.vus.values.max").alias("vus"),
        iterations.alias("iterations"),
        F.col("state.warmupRequests").alias("warmup"),
        _fixed(F.col("metrics.setup_duration_ms.values.avg") / 1000).alias("setup_s"),
        _fixed(F.col("state.scenarioSeconds")).alias("scenario_s"),
        _fixed(iterations / F.col("state.scenarioSeconds")).alias("iterations_per_s"),
        _fixed(F.col(f"{duration}.avg")).alias("avg_ms"),
        _fixed(F.col(f"{duration}.`p(95)`")).alias("p95_ms"),
        _fixed(F.col(f"{duration}.`p(99)`")).alias("p99_ms"),
        _fixed(F.col("metrics.http_req_failed.values.rate") * 100).alias("failed_percent"),
    )


def text(report: DataFrame) -> DataFrame:
    """One text block per run."""
    lines = [
        ("Endpoint", "{endpoint}", ""),
        ("VUs", "{vus}", ""),
        ("Iterations", "{iterations}", ""),
        ("Warmup", "{warmup}", None),
        ("Scenario time", "{scenario_s}", " s"),
        ("Iterations/sec", "{iterations_per_s}", ""),
        ("Req avg", "{avg_ms}", " ms"),
        ("Req p95", "{p95_ms}", " ms"),
        ("Req p99", "{p99_ms}", " ms"),
        ("Failed requests", "{failed_percent}", " %"),
    ]
    blocks = [
        F.concat(
            F.lit(f"{label}:".ljust(17)), F.coalesce(F.col(field.strip("{}")).cast("string"), F.lit("n/a")),
            F.concat(F.lit(" requests, "), F.col("setup_s"), F.lit(" s")) if unit is None else F.lit(unit),
        )
        for label, field, unit in lines
    ]
    return figures(report).select("endpoint", F.concat_ws("\n", *blocks).alias("text"))
