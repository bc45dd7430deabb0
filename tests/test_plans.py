"""What the plans of the batch queries may and may not hold."""

import pytest

from bench import BATCH
from tallypost import fixtures as X
from tallypost.operators import delivery as D, outbox as O
from tallypost.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition, REPARTITION"):
        assert word not in text, word


def test_status_reads_two_columns_of_each_side(spark, small):
    text = plan(D.delivery_status(X.messages(spark, small), X.deliveries(spark, small)))
    scans = [line for line in text.splitlines() if "ReadSchema" in line]
    assert scans and all("struct<event_id:bigint,ts:timestamp_ntz>" in line for line in scans)
    assert "SortAggregate" not in text


def test_each_side_of_the_match_is_shuffled_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(D.delivery_match(X.messages(spark, small), D.first_delivery(X.deliveries(spark, small))))
        assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in text
        state = plan(O.outbox_state(X.messages(spark, small), X.outbox_attempts(spark, small)))
        assert state.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_wide_shuffle_for_quantiles(spark, small):
    df = QUERIES["latency_trend"](spark, small)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1
