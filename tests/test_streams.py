from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallypost import fixtures as X
from tallypost.operators import delivery as D
from tallypost.plans.replays import Landing, as_stream_time, run_over
from tallypost.session import prepare
from tallypost.sinks import topics as topic_sinks
from tallypost.sources import topics as topic_sources
from tallypost.streaming import delivery as SD
from tallypost.streaming.run import append_sink, read_sink, run_available, time_cuts


@pytest.fixture
def both(spark, small):
    prepare(spark)
    return {
        "messages": (X.messages(spark, small), "created_at"),
        "deliveries": (X.deliveries(spark, small), "delivered_at"),
    }


@pytest.mark.parametrize("turned", [False, True])
def test_prompt_form_in_any_order(spark, both, turned):
    """The join comes before the choice of a copy: what comes first to hand does not matter."""
    if turned:
        at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("decimal(18,6)"))
        both = {n: (df.withColumn("arrived", at), "arrived") for n, (df, _) in both.items()}
    out = run_over(
        spark, "t", both, lambda messages, deliveries: SD.rendezvous(messages, deliveries, delay="40 days"),
        end_gap=timedelta(days=90),
    )
    met = D.delivery_match(both["messages"][0], D.first_delivery(both["deliveries"][0]))
    got = out.where("delivered_at is not null").select("id", "content", F.col("delivered_at").cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, met.select("id", "content", "delivered_at").collect()))
    assert out.count() == 1000 and out.where("delivered_at is null").count() == 164


def test_a_late_copy_does_not_hide_one_in_time(spark, tmp_path):
    prepare(spark)
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([(1, "x", at), (2, "y", at)], "id int, content string, created_at timestamp")
    late, early = at + timedelta(seconds=90), at + timedelta(seconds=5)
    d = spark.createDataFrame(
        [(1, "late", late, 1), (1, "early", early, 2), (2, "late", late, 3)], "id int, content string, delivered_at timestamp, log_offset long"
    )
    for n, df in (("m", m), ("d", d)):
        df.coalesce(1).write.parquet(str(tmp_path / n))
    end = datetime(2024, 1, 3)
    spark.createDataFrame([(-1, "", end)], m.schema).write.mode("append").parquet(str(tmp_path / "m"))
    spark.createDataFrame([(-1, "", end, 0)], d.schema).write.mode("append").parquet(str(tmp_path / "d"))
    out = SD.rendezvous(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), spark.readStream.schema(d.schema).parquet(str(tmp_path / "d")))
    run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r["id"]: r["content"] for r in read_sink(spark, str(tmp_path / "out"), out).where("id > 0").collect()}
    assert got == {1: "early", 2: None}


@pytest.mark.parametrize("first", ["messages", "deliveries"])
def test_either_side_may_come_first(spark, both, first, tmp_path):
    """One side is landed a run before the other; the watermark waits for both."""
    lands = {n: Landing(df, arrival, str(tmp_path / n)) for n, (df, arrival) in both.items()}
    for land in lands.values():
        land.df.limit(0).write.parquet(land.path)

    def run():
        out = SD.delivery_status_stream(lands["messages"].stream(), lands["deliveries"].stream())
        run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
        return out

    second = "deliveries" if first == "messages" else "messages"
    lands[first].land([], 0)
    run()
    lands[second].land([], 0)
    run()
    for land in lands.values():
        land.land_end(datetime(2024, 3, 1))
    out = run()
    got = read_sink(spark, str(tmp_path / "out"), out).where("id <> -1").groupBy("status").count().collect()
    assert {r[0]: r[1] for r in got} == {"confirmed": 836, "late": 139, "orphan": 20, "pending": 25}


def test_settled_first_delivery_is_the_lowest_offset_in_any_order(spark, tmp_path):
    """Copies of a message, a third of all rows, arrive highest offset first."""
    prepare(spark)
    n = F.col("id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.range(0, 3000, 1, 8).select(
        F.when(n % 3 == 0, 1).otherwise(n % 50 + 2).cast("int").alias("id"),
        F.concat(F.lit("c"), (3000 - n).cast("string")).alias("content"),
        at.alias("created_at"), (at + F.expr("interval '5' second")).alias("delivered_at"),
        F.lit(0).alias("log_partition"), (3000 - n).alias("log_offset"),
    )
    land = Landing(rows, "delivered_at", str(tmp_path / "in"))
    land.land([], 0)
    out = SD.first_delivery_stream(land.stream())
    run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    land.land_end(datetime(2024, 1, 2))
    run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = read_sink(spark, str(tmp_path / "out"), out).where("id <> -1")
    assert sorted(map(tuple, got.select("id", "log_offset").collect())) == sorted(
        map(tuple, D.first_delivery(rows).select("id", "log_offset").collect())
    )


def test_repeats_are_thinned(spark):
    """Of each batch stays the lowest offset of an id; a batch has as many rows as this test says."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    n = F.col("id")
    rows = spark.range(0, 30_000, 1, 3).select(
        F.when(n % 3 == 0, 1).when(n % 1000 == 1, None).otherwise(n + 10).cast("int").alias("id"), n.alias("log_offset"),
        F.lit("2024-01-01").cast("timestamp").alias("delivered_at"),
    )
    try:
        thin = SD.thin_repeats(rows)
        assert thin.where("id = 1").count() == 3 and thin.where("id = 1 and log_offset % 10000 < 3").count() == 3
        assert thin.where("id <> 1").count() == rows.where("id <> 1").count()
        assert thin.where("id is null").count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_state_is_dropped_behind_the_watermark(spark, both, tmp_path):
    lands = {n: Landing(df, arrival, str(tmp_path / n)) for n, (df, arrival) in both.items()}
    for land in lands.values():
        land.land([], 0)
        land.land_end(datetime(2024, 3, 1))
    out = SD.delivery_status_stream(lands["messages"].stream(), lands["deliveries"].stream())
    query = append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [op.numRowsTotal for op in query.lastProgress.stateOperators]
    assert max(kept) <= 2, kept


def test_time_cuts(spark, small):
    m = as_stream_time(X.messages(spark, small))
    cuts = time_cuts(m, "created_at", 4)
    assert len(cuts) == 3 and cuts == sorted(cuts)
    assert time_cuts(m.limit(0), "created_at", 4) == []


def test_kafka_options():
    assert topic_sources.kafka_options("b:9092", "messages", "my-group") == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "messages", "kafka.group.id": "my-group",
        "startingOffsets": "latest",
    }
    assert topic_sinks.kafka_options("b:9092")["kafka.acks"] == "all"


def test_stream_topic_sink(spark, tmp_path):
    from tallypost.functions import codec

    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    spark.range(9).select(F.col("id").cast("int"), F.lit("x").alias("content"), at.alias("created_at")).write.parquet(
        str(tmp_path / "m")
    )
    m = spark.readStream.schema("id int, content string, created_at timestamp").parquet(str(tmp_path / "m"))
    out = codec.encode_records(m)
    run_available(topic_sinks.stream_topic(out, fmt="parquet", path=str(tmp_path / "t"), checkpoint=str(tmp_path / "c")))
    back = topic_sources.message_topic(spark, fmt="parquet", path=str(tmp_path / "t"), stream=False)
    assert sorted(r["id"] for r in codec.decode_records(back).collect()) == list(range(9))


def test_an_event_with_another_time_of_writing_still_meets_its_message(spark, tmp_path):
    """Times on the wire may have more digits than stored ones: the id alone tells who belongs together."""
    prepare(spark)
    at = datetime(2024, 1, 1, 0, 0, 0, 123456)
    m = spark.createDataFrame([(7, "x", at)], "id int, content string, created_at timestamp")
    d = spark.createDataFrame(
        [(7, "x", at + timedelta(microseconds=1), at + timedelta(seconds=4), 1), (7, "x", None, at + timedelta(seconds=9), 2)],
        "id int, content string, created_at timestamp, delivered_at timestamp, log_offset long",
    )
    out = run_over(spark, "t", {"messages": (m, "created_at"), "deliveries": (d, "delivered_at")}, SD.delivery_status_stream)
    assert [(r["id"], r["status"]) for r in out.collect()] == [(7, "confirmed")]
    first = run_over(spark, "t", {"deliveries": (d, "delivered_at")}, SD.first_delivery_stream)
    assert [(r["id"], r["log_offset"]) for r in first.collect()] == [(7, 1)]


def test_open_writes_are_those_without_a_delivery(spark, both, tmp_path):
    """The state of a stopped stream against an anti join of what had come until then."""
    cut = datetime(2024, 1, 10)
    some = {n: df.where(F.col(at) < F.lit(cut)) for n, (df, at) in both.items()}
    lands = {n: Landing(df, both[n][1], str(tmp_path / n)) for n, df in some.items()}
    for land in lands.values():
        land.land([], 0)
    out = SD.delivery_status_stream(lands["messages"].stream(), lands["deliveries"].stream(), delay="100 days", gap=SD.DELAY)
    run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    expected = sorted(r["id"] for r in D.undelivered(some["messages"], some["deliveries"]).collect())
    assert sorted(r["id"] for r in SD.open_writes(spark, str(tmp_path / "cp")).collect()) == expected and expected
