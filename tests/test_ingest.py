import json

import pytest
from pyspark.sql import functions as F

from tallypost.functions.codec import parse_message
from tallypost.operators.ingest import assign_id, stamp
from tallypost.sinks.batches import BatchStore
from tallypost.sources import landing
from tallypost.streaming import ingest as SI
from tallypost.streaming.run import run_available


def clock():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def test_ids_are_dense_over_uneven_tasks(spark):
    # Same body in every row; one task holds far more rows than the others.
    parts = [spark.range(n).select(F.lit("Hello").alias("content")) for n in (5000, 0, 1, 37, 400)]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    ids = sorted(r["id"] for r in assign_id(stamp(df, clock()), high_water_mark=100).collect())
    assert ids == list(range(101, 101 + 5438))


def test_ids_need_no_shuffle_of_the_rows(spark):
    df = stamp(spark.range(1000).select(F.col("id").cast("string").alias("content")), clock())
    plan = assign_id(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("hashpartitioning") <= 2 and "BroadcastHashJoin" in plan


def test_id_overflow_is_an_error(spark):
    df = stamp(spark.range(10).select(F.lit("x").alias("content")), clock())
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        assign_id(df, high_water_mark=2**31 - 5).collect()


def test_stamp_ignores_client_fields(spark):
    df = spark.createDataFrame([(99, "x", "2000-01-01")], "id int, content string, created_at string")
    assert stamp(df, clock()).columns == ["content", "created_at"]
    assert stamp(df).schema["created_at"].dataType.typeName() == "timestamp"


def test_bodies(spark, tmp_path):
    lines = ['{"content":"a"}', '{"CONTENT":"b","id":9}', "{}", '{"content":null}', "{", "[1]", '{"content":5,"x":']
    (tmp_path / "b.json").write_text("\n".join(lines))
    df = landing.bodies(spark, str(tmp_path), stream=False)
    assert sorted(r[0] for r in landing.accepted(df).collect()) == ["", "a", "b"]
    assert df.where("malformed").count() == 4


def post(folder, name, contents):
    (folder / name).write_text("\n".join(json.dumps({"content": c}) for c in contents))


def test_cowrite_over_batches_and_restart(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    read = landing.accepted(landing.bodies(spark, str(tmp_path / "in")))
    for n in range(3):
        post(tmp_path / "in", f"{n}.json", [f"m{n}-{i}" for i in range(20)])
        run_available(SI.ingest(read, store, str(tmp_path / "cp"), clock=clock(), outbox=True))
    rows = {r["id"]: r["content"] for r in SI.stored_messages(store).collect()}
    assert sorted(rows) == list(range(1, 61))
    payload = SI.stored_outbox(store).select(F.explode(F.array(parse_message(F.col("payload").cast("string")))).alias("p"))
    assert {r["id"]: r["content"] for r in payload.select("p.value.*").collect()} == rows
    assert SI.stored_outbox(store).select("id").distinct().count() == 60


class Broken(BatchStore):
    """Fails between the two writes of a batch."""

    def put(self, df, table, batch_id):
        if table == SI.OUTBOX_ROWS and batch_id == 1:
            raise RuntimeError("lost the executor")
        super().put(df, table, batch_id)


def test_failure_between_the_writes_shows_neither(spark, tmp_path):
    bodies = spark.range(10).select(F.col("id").cast("string").alias("content"))
    broken, store = Broken(spark, str(tmp_path)), BatchStore(spark, str(tmp_path))
    SI.write_batch(bodies, 0, broken, clock(), outbox=True)
    with pytest.raises(RuntimeError):
        SI.write_batch(bodies, 1, broken, clock(), outbox=True)
    assert SI.stored_messages(store).count() == SI.stored_outbox(store).count() == 10
    SI.write_batch(bodies, 1, store, clock(), outbox=True)  # the repeat of the batch
    assert sorted(r["id"] for r in SI.stored_messages(store).collect()) == list(range(1, 21))
    assert SI.stored_outbox(store).count() == 20


def test_dual_write_gap(spark, tmp_path):
    """The row is committed first; a failing producer leaves it without an event."""
    store = BatchStore(spark, str(tmp_path))
    bodies = spark.range(3).select(F.col("id").cast("string").alias("content"))

    def fail(_):
        raise RuntimeError("broker down")

    with pytest.raises(RuntimeError):
        SI.write_batch(bodies, 0, store, clock(), produce=fail)
    assert SI.stored_messages(store).count() == 3


def test_an_empty_batch_keeps_the_mark(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    bodies = spark.range(3).select(F.col("id").cast("string").alias("content"))
    SI.write_batch(bodies, 0, store, clock())
    SI.write_batch(bodies.limit(0), 1, store, clock())
    SI.write_batch(bodies, 2, store, clock())
    assert sorted(r["id"] for r in SI.stored_messages(store).collect()) == [1, 2, 3, 4, 5, 6]


def test_a_store_without_the_batch_before_is_refused(spark, tmp_path):
    """Starting over from id 1 would hand out ids twice."""
    bodies = spark.range(3).select(F.col("id").cast("string").alias("content"))
    with pytest.raises(RuntimeError, match="do not belong together"):
        SI.write_batch(bodies, 4, BatchStore(spark, str(tmp_path)), clock())


def test_ids_beyond_the_int_range_fail_without_ansi_too(spark):
    import pytest

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "content string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="beyond the int range"):
            assign_id(rows, (1 << 31) - 3).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
