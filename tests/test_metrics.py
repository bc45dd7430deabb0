import math
import random

import pytest
from pyspark.sql import functions as F

from tallypost.functions.quantiles import trend, trends
from tallypost.operators import metrics as M
from tallypost.sinks import report

PROBS = {"q0": 0.0, "q10": 0.1, "med": 0.5, "p95": 0.95, "p99": 0.99, "q100": 1.0}


def brute(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    low, high = math.floor(pos), math.ceil(pos)
    return v[low] if low == pos else (high - pos) * v[low] + (pos - low) * v[high]


def shapes():
    rng = random.Random(5)
    yield "continuous", [rng.expovariate(0.02) for _ in range(4000)]
    yield "one hot value", [42.5] * 3000 + [rng.random() * 5000 for _ in range(2000)]
    yield "all equal", [3.25] * 500
    yield "single", [1.5]
    yield "two", [1.0, 2.0]
    yield "wide", [rng.choice([0.0, 1e-3, 600_000.0]) * rng.random() for _ in range(3000)]


@pytest.mark.parametrize("shape", list(shapes()), ids=lambda s: s[0])
def test_quantiles_equal_brute_force(spark, shape):
    values = [round(v, 6) for v in shape[1]]
    other = [round(v * 3 + 1, 6) for v in values[:100]]
    df = spark.createDataFrame(
        [("a", v) for v in values] + [("b", v) for v in other] + [("a", None)], "g string, v double"
    ).repartition(7)
    got = {r["g"]: r for r in trend(df, ["g"], "v", PROBS).collect()}
    for g, vs in (("a", values), ("b", other)):
        assert got[g]["n"] == len(vs)
        assert got[g]["min"] == min(vs) and got[g]["max"] == max(vs)
        assert got[g]["avg"] == pytest.approx(sum(vs) / len(vs))
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(brute(vs, p), abs=1e-9), (g, name)


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r["g"]: r["med"] for r in trend(df, ["g"], "v", {"med": 0.5}).collect()} == {None: 2.0, "a": 5.0}


def test_series_share_a_pass(spark):
    values = [(g, float(v % 37) * 1.5, v % 3 == 0) for v in range(500) for g in ("a", "b")] + [("c", 1.0, False)]
    df = spark.createDataFrame(values, "g string, v double, third boolean").repartition(5)
    got = {r["g"]: r for r in trends(df, ["g"], "v", PROBS, {"all": F.lit(True), "third": F.col("third")}).collect()}
    for g in "ab":
        for name, keep in (("all", lambda t: True), ("third", lambda t: t)):
            vs = [v for h, v, t in values if h == g and keep(t)]
            assert got[g][name]["n"] == len(vs) and got[g][name]["max"] == max(vs)
            for q, p in PROBS.items():
                assert got[g][name][q] == pytest.approx(brute(vs, p), abs=1e-9)
    assert got["c"]["all"]["med"] == 1.0
    assert got["c"]["third"].asDict() == {"n": 0, "avg": None, "min": None, "max": None, **dict.fromkeys(PROBS)}


def samples(spark):
    return spark.sql("""
        select id as request_id, '/naive' as endpoint, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as started_at,
               10.0D + id as duration_ms, if(id = 3, 500, 201) as status_code, id < 2 as warmup, cast(id as int) as vus
        from range(11)""")


def test_totals(spark):
    r = M.run_totals(samples(spark)).first()
    assert (r["requests"], r["check_passes"], r["check_fails"], r["failed_requests"]) == (11, 10, 1, 1)
    assert (r["run_seconds"], r["timed_seconds"], r["iterations"]) == (10.02, 8.02, 9)
    assert (r["vus_last"], r["vus_min"], r["vus_max"]) == (10, 0, 10)
    assert M.net_throughput(M.run_totals(samples(spark))).first()["per_second"] == 9 / 8.02
    assert M.failure_threshold(M.run_totals(samples(spark))).first()["ok"] is False


def test_totals_are_hash_aggregates(spark):
    plan = M.run_totals(samples(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_gauge_takes_the_later_request_at_equal_times(spark):
    df = samples(spark).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    r = M.run_totals(df).first()
    assert r["vus_last"] == 10 and r["run_seconds"] == 0.02


def test_both_trends_in_one_pass_equal_the_single_ones(spark):
    r = M.latency_trends(samples(spark)).first()
    for name, single in (("all", M.latency_trend), ("expected", M.expected_latency)):
        want = single(samples(spark)).first().asDict()
        want.pop("endpoint")
        assert r[name].asDict() == want


def test_path_filter(spark):
    paths = ["/health", "/HEALTH/", "/alive/x", "/healthy", "/", "", None, "/x/health", "/alive"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in M.path_filter(df).collect()] == ["/healthy", "/", "", None, "/x/health"]


def test_report_round_trip_and_text(spark, tmp_path):
    built = report.summary(samples(spark))
    report.write_summary(built, str(tmp_path / "r"))
    back = report.read_summary(spark, str(tmp_path / "r"), built)
    assert back.collect() == built.collect()
    values = back.select("metrics.http_req_failed").first()[0]
    assert values["type"] == "rate" and values["values"]["passes"] == 1 and values["thresholds"][0]["ok"] is False
    text = report.text(back).first()["text"].splitlines()
    assert text[0] == "Endpoint:        /naive" and text[5] == "Iterations/sec:  1.12" and text[3] == "Warmup:          2 requests, 2.00 s" and text[1] == "VUs:             10" and text[-1] == "Failed requests: 9.09 %"
