
from tallypost.functions import codec
from tallypost.operators import changes as C
from tallypost.schemas import CDC_TOPIC, CHANGE, MESSAGE_TOPIC, TOPIC_RECORD
from tallypost.sinks.batches import BatchStore
from tallypost.sources import changes as change_sources, topics as topic_sources
from tallypost.streaming import quarantine
from tallypost.streaming.run import append_sink, read_sink, run_available


def landed_records(spark, path, values, topic=MESSAGE_TOPIC):
    rows = [
        (i.to_bytes(4, "big"), None if v is None else v.encode(), topic, 0, i, None) for i, v in enumerate(values)
    ]
    spark.createDataFrame(rows, TOPIC_RECORD).write.mode("append").parquet(path)


def test_poison_values_are_set_aside_whole(spark, tmp_path):
    path, store = str(tmp_path / "in"), BatchStore(spark, str(tmp_path / "store"))
    good = '{"id":%d,"content":"x","createdAt":"2024-01-01T00:00:00Z"}'
    landed_records(spark, path, [good % 0, "{poison", None, good % 3])
    decoded = codec.decode_records(topic_sources.message_topic(spark, fmt="parquet", path=path))
    for _ in range(2):
        run_available(quarantine.split_stream(decoded, store, str(tmp_path / "cp")))
        landed_records(spark, path, [good % 0])
    kept = spark.read.parquet(str(tmp_path / "store" / quarantine.GOOD))
    assert sorted((r["id"], r["message"] is None) for r in kept.collect()) == [(0, False), (0, False), (2, True), (3, False)]
    bad = spark.read.parquet(str(tmp_path / "store" / quarantine.QUARANTINE)).collect()
    assert [(bytes(r["value"]), r["offset"]) for r in bad] == [(b"{poison", 1)]


def test_topics_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "in")
    landed_records(spark, path, ["{}"])
    landed_records(spark, path, ["{}", None], CDC_TOPIC)
    assert topic_sources.message_topic(spark, fmt="parquet", path=path, stream=False).count() == 1
    cdc = topic_sources.cdc_topic(spark, fmt="parquet", path=path, stream=False)
    assert [r["value"] for r in cdc.orderBy("log_offset").collect()] == ["{}", None]


def test_change_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], CHANGE).write.parquet(str(tmp_path / "c"))
    changes = change_sources.change_stream(spark, str(tmp_path / "c"), stream=False)
    rows = C.project_by_name(C.table_filter(C.insert_only(changes))).select("id", "content")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,insert)" in plan and "EqualTo(relation,messages)" in plan
    assert "wal_end" not in plan.split("ReadSchema")[1] and "created_at" not in plan.split("ReadSchema")[1]


def test_changes_from_a_topic(spark, tmp_path):
    landed_records(spark, str(tmp_path / "in"), ['{"wal_end":64,"relation":"messages","kind":"insert","id":1,"content":"a"}'])
    records = topic_sources.message_topic(spark, fmt="parquet", path=str(tmp_path / "in"))
    out, _ = change_sources.changes_from_topic(records)
    run_available(append_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    r = read_sink(spark, str(tmp_path / "out"), out).first()
    assert (r["wal_end"], r["kind"], r["id"], r["content"], r["created_at"]) == (64, "insert", 1, "a", None)


def test_topic_route(spark):
    df = spark.createDataFrame([("messages",), ("OutboxMessages",)], "relation string")
    assert [r["topic"] for r in C.topic_route(df).collect()] == [CDC_TOPIC, "cdc.public.OutboxMessages"]
