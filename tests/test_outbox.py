from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallypost import fixtures as X
from tallypost.functions import codec
from tallypost.operators import outbox as O
from tallypost.schemas import OUTBOX
from tallypost.sinks.batches import BatchStore
from tallypost.sources.topics import message_topic
from tallypost.streaming import outbox as SO
from tallypost.streaming.run import run_available

START = datetime(2024, 3, 1)


def rows(spark, n):
    messages = spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("m"), "id").alias("content"),
        (F.lit(START - timedelta(hours=1)).cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)")))
        .alias("created_at"),
    )
    return O.outbox_row(messages)


def accept(due):
    return due.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def states(store):
    return {r["id"]: (r["status"], r["retry_count"], r["dead_letter_error"]) for r in SO.outbox_table(store).collect()}


def test_state_counts(spark, small):
    state = O.outbox_state(X.messages(spark, small), X.outbox_attempts(spark, small))
    by = {r["status"]: r["n"] for r in state.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 1000 and set(by) == {0, 1, 2}
    assert state.where("status = 2 and (dead_letter_error is null or retry_count < 3)").count() == 0


def test_batch_is_top_k_without_a_full_sort(spark, small):
    state = O.outbox_state(X.messages(spark, small), X.outbox_attempts(spark, small))
    batch = O.outbox_batch(state, F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"))
    assert "TakeOrderedAndProject" in batch._jdf.queryExecution().executedPlan().toString()
    assert batch.count() == 50


def test_polls_take_a_batch_each_oldest_first(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    seen = []

    def note(due):
        seen.append([r["created_at"] for r in due.orderBy("created_at").collect()])
        return accept(due)

    SO.poll(rows(spark, 120), 0, store, note, lambda: START)
    none = spark.createDataFrame([], OUTBOX)
    for n in (1, 2, 3):
        SO.poll(none, n, store, note, lambda: START)
    assert [len(s) for s in seen] == [50, 50, 20]
    assert store.last_batch() == 3 and not (tmp_path / "open" / "batch_id=3").exists()
    assert sum(seen, []) == sorted(sum(seen, []))
    assert set(states(store).values()) == {(1, 0, None)} and len(states(store)) == 120


def test_retries_back_off_then_end_as_dead_letter(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    none = spark.createDataFrame([], OUTBOX)

    def fail(due):
        raise RuntimeError("broker away")

    def at(s):
        return lambda: START + timedelta(seconds=s)

    SO.poll(rows(spark, 3), 0, store, fail, at(0))      # first failure, next try after 2 s
    SO.poll(none, 1, store, fail, at(1))                # not due
    assert {s[:2] for s in states(store).values()} == {(0, 1)}
    SO.poll(none, 2, store, fail, at(2))                # second failure, next try after 4 s
    SO.poll(none, 3, store, fail, at(5))                # not due
    assert {s[:2] for s in states(store).values()} == {(0, 2)}
    SO.poll(none, 4, store, fail, at(6))                # third failure
    assert set(states(store).values()) == {(2, 3, "broker away")}
    SO.poll(none, 5, store, accept, at(1000))           # dead rows stay dead
    assert {s[0] for s in states(store).values()} == {2}
    assert SO.attempt_log(store).count() == 9
    by_log = O.outbox_state(rows(spark, 3), SO.attempt_log(store))
    assert {(r["status"], r["retry_count"], r["dead_letter_error"]) for r in by_log.collect()} == {(2, 3, "broker away")}


def test_rows_without_an_outcome_stay(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))

    def some(due):
        told = due.where("retry_count = 0").orderBy("id").limit(6).select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
        return told.unionByName(told)

    SO.poll(rows(spark, 10), 0, store, some, lambda: START)
    after = states(store)
    assert len(after) == 10 and sorted(s[:2] for s in after.values()) == [(0, 1)] * 4 + [(1, 0)] * 6
    assert SO.attempt_log(store).where("not ok").select("error").distinct().first()[0] == SO.NO_OUTCOME


def test_a_repeated_poll_changes_nothing(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    SO.poll(rows(spark, 60), 0, store, accept, lambda: START)
    once = states(store)
    SO.poll(rows(spark, 60), 0, store, accept, lambda: START)
    assert states(store) == once and SO.attempt_log(store).count() == 50


def test_stream_to_topic(spark, tmp_path):
    rows(spark, 40).repartition(3).write.parquet(str(tmp_path / "rows"))
    store = BatchStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(OUTBOX).parquet(str(tmp_path / "rows"))
    send = SO.topic_dispatcher(fmt="parquet", path=str(tmp_path / "topic"))
    for _ in range(2):
        run_available(SO.dispatch(stream, store, str(tmp_path / "cp"), send, clock=lambda: START))
    sent = codec.decode_records(message_topic(spark, fmt="parquet", path=str(tmp_path / "topic"), stream=False))
    got = {r["id"]: r["content"] for r in sent.select("id", "message.content").collect()}
    assert got == {i: f"m{i}" for i in range(1, 41)}


def test_ticks_poll_without_new_rows(spark, tmp_path):
    rows(spark, 12).write.parquet(str(tmp_path / "rows"))
    store = BatchStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(OUTBOX).parquet(str(tmp_path / "rows"))
    query = SO.dispatch(SO.with_ticks(stream), store, str(tmp_path / "cp"), accept, clock=lambda: START, limit=5).start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if store.last_batch() >= 3 and sum(s[0] == 1 for s in states(store).values()) == 12:
                break
    finally:
        query.stop()
    assert sum(s[0] == 1 for s in states(store).values()) == 12
