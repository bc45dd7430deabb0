"""Rows without arrival time or id, and with any id, pass a replay."""

import pytest
from pyspark.sql import functions as F

from tallypost import fixtures as X
from tallypost.operators import delivery as D
from tallypost.plans.replays import as_stream_time, run_over
from tallypost.session import prepare
from tallypost.streaming import delivery as SD


@pytest.fixture
def gaps(spark, small):
    prepare(spark)
    n = F.col("log_offset")
    return as_stream_time(X.deliveries(spark, small)).withColumns({
        "delivered_at": F.when(F.col("id") % 10 != 1, F.col("delivered_at")),
        "id": F.when(n == 30, -1).when(n == 60, -(1 << 31)).when(n != 90, F.col("id")),
    })


def test_a_replay_returns_every_row(spark, gaps):
    out = run_over(spark, "t", {"deliveries": (gaps, "delivered_at")}, lambda deliveries: deliveries, slices=4)
    assert gaps.where("delivered_at is null").count() > 0 and gaps.where("id is null").count() == 1
    assert out.count() == gaps.count() == 1030
    assert out.exceptAll(gaps).isEmpty() and gaps.exceptAll(out).isEmpty()


def test_rows_without_arrival_do_not_make_others_late(spark, small):
    prepare(spark)
    d = as_stream_time(X.deliveries(spark, small))
    d = d.withColumn("delivered_at", F.when(F.col("id") % 10 != 1, F.col("delivered_at")))
    out = run_over(spark, "t", {"deliveries": (d, "delivered_at")}, lambda deliveries: SD.first_delivery_stream(deliveries))
    twin = D.first_delivery(d).select(out.columns)
    assert d.where("delivered_at is null").count() > 50
    assert out.exceptAll(twin).isEmpty() and twin.exceptAll(out).isEmpty()


def test_no_arrival_at_all(spark, gaps):
    none = gaps.withColumns({c: F.lit(None).cast("timestamp") for c in ("delivered_at", "created_at")})
    out = run_over(spark, "t", {"deliveries": (none, "delivered_at")}, lambda deliveries: deliveries)
    assert out.count() == 1030
