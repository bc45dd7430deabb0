from pyspark.sql import functions as F

from tallypost import fixtures as X
from tallypost.operators import delivery as D, quality as Q


def hot_deliveries(spark, rows=60_000):
    """One id holds a third of all rows, in an order that does not follow the offsets."""
    n = F.col("id")
    return spark.range(0, rows, 1, 16).select(
        F.when(n % 3 == 0, 7).otherwise((n % 5000) + 10).cast("int").alias("id"),
        F.concat(F.lit("c"), (rows - n).cast("string")).alias("content"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (rows - n) % 90).alias("delivered_at"),
        (rows - n).alias("log_offset"),
    )


def test_first_delivery_of_a_hot_id(spark):
    df = hot_deliveries(spark)
    want = {}
    for r in df.collect():
        if r["id"] not in want or r["log_offset"] < want[r["id"]]["log_offset"]:
            want[r["id"]] = r
    got = {r["id"]: r for r in D.first_delivery(df).collect()}
    assert got == want
    status = D.delivery_status(df.where("id % 2 = 0"), df).collect()  # written more than once, too
    assert {r["id"]: r["delivered_at"] for r in status} == {k: r["delivered_at"] for k, r in want.items()}
    assert {r["id"] for r in status if r["status"] == "orphan"} == {k for k in want if k % 2}


def test_hot_id_is_combined_before_the_shuffle(spark):
    plan = D.first_delivery(hot_deliveries(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(id")
    df = hot_deliveries(spark)
    quick = D.delivery_status(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in quick and "partial_min_by" in quick and quick.count("Exchange") == 1


def test_status_adds_up(spark, small):
    m, d = X.messages(spark, small), X.deliveries(spark, small)
    counts = {r[0]: r[1] for r in D.status_counts(D.delivery_status(m, d)).collect()}
    assert counts["confirmed"] + counts["late"] + counts["pending"] == m.count()
    assert counts["orphan"] == D.orphan_deliveries(m, D.first_delivery(d)).count()
    assert counts["pending"] == D.undelivered(m, d).count()


def test_wait_bound_is_inclusive(spark):
    at = "timestamp'2024-01-01 00:00:{}'"
    m = spark.sql(f"select 1 id, {at.format('00')} created_at union all select 2, {at.format('00')} union all select 3, {at.format('00')}")
    d = spark.sql(
        f"select 1 id, 'x' content, {at.format('00')} created_at, timestamp'2024-01-01 00:01:00' delivered_at, 1L log_offset "
        f"union all select 2, 'x', {at.format('00')}, timestamp'2024-01-01 00:01:00.000001', 2L"
    )
    got = {r["id"]: r["status"] for r in D.delivery_status(m, d).collect()}
    assert got == {1: "confirmed", 2: "late", 3: "pending"}
    assert [r["id"] for r in D.delivery_match(m, d).collect()] == [1]


def test_constraints(spark):
    rows = [(1, "a" * 300), (1, "b"), (2, None), (None, "c")]
    r = Q.constraint_check(spark.createDataFrame(rows, "id int, c string"), "id", ("c",), {"c": 256}).first()
    assert r.asDict() == {"rows": 4, "duplicate_keys": 1, "null_id": 1, "null_c": 1, "too_long_c": 1}
