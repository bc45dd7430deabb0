"""What is kept between batches: ids for several writers, unique keys, tries, positions, counters."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallypost import fixtures as X
from tallypost.functions import codec, sketches
from tallypost.operators import outbox as O
from tallypost.plans.replays import Landing, as_stream_time
from tallypost.sinks import committed, files
from tallypost.sinks.batches import BatchStore
from tallypost.sinks.ledger import IdLedger
from tallypost.sinks.unique import NotUnique, UniqueTable
from tallypost.sources import changes as change_sources, slots
from tallypost.streaming import ingest as SI, observed as SOb, outbox as SO
from tallypost.streaming.attempts import AttemptLog
from tallypost.streaming.due_queue import DueQueue
from tallypost.streaming.run import append_sink, read_sink, run_available
from tallypost.schemas import OUTBOX

START = datetime(2024, 3, 1)


def bodies(spark, n, tag="b"):
    return spark.range(n).select(F.concat(F.lit(tag), "id").alias("content"))


# Ids.

def test_blocks_belong_to_one_writer(spark, tmp_path):
    root = str(tmp_path)
    one, two = IdLedger(spark, root, size=10), IdLedger(spark, root, size=10)
    taken = {}
    for batch, (a, b) in enumerate([(7, 25), (3, 0), (31, 4)]):
        for name, ledger, n in (("one", one, a), ("two", two, b)):
            df = ledger.assign(bodies(spark, n, f"{name}{batch}-"), name, batch)
            taken[name, batch] = {r["content"]: r["id"] for r in df.collect()}
            assert len(taken[name, batch]) == n
    ids = [i for some in taken.values() for i in some.values()]
    assert len(set(ids)) == len(ids) and min(ids) == 1
    # a batch goes on in the block that the one before it left
    assert set(taken["one", 0].values()) | set(taken["one", 1].values()) == set(range(1, 11))
    fresh = IdLedger(spark, root, size=10)
    again = {r["content"]: r["id"] for r in fresh.assign(bodies(spark, 0), "one", 2).collect()}
    assert again == taken["one", 2]
    with pytest.raises(RuntimeError, match="came back with"):
        fresh.reserve("one", 2, 5)


def test_a_lost_writer_leaves_a_gap(spark, tmp_path):
    root = str(tmp_path)
    assert files.claim(spark, f"{root}/blocks/{0:010d}") and not files.claim(spark, f"{root}/blocks/{0:010d}")
    got = IdLedger(spark, root, size=10).assign(bodies(spark, 3), "one", 0)
    assert sorted(r["id"] for r in got.collect()) == [11, 12, 13]


def test_a_repeated_batch_writes_nothing_and_is_produced_again(spark, tmp_path):
    store, sent = BatchStore(spark, str(tmp_path)), []

    def produce(stored):
        sent.append(sorted(map(tuple, stored.select("id", "content").collect())))

    clock = F.lit(START).cast("timestamp")
    SI.write_batch(bodies(spark, 20), 0, store, clock, outbox=True, produce=produce)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    SI.write_batch(bodies(spark, 20).orderBy(F.rand(3)), 0, store, clock, outbox=True, produce=produce)
    assert sent[0] == sent[1] and len(sent[0]) == 20
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before


# Unique keys.

UNIQUE = "id long, content string, log_offset long"


def test_conflicts_are_found_before_a_batch_is_visible(spark, tmp_path):
    schema = spark.createDataFrame([], UNIQUE).schema
    table = UniqueTable(spark, str(tmp_path), schema, "log_offset")
    big = 10_000_000_000
    batches = [
        [(1, "a", 1), (2, "b", 2), (2, "B", 3), (-5, "n", 4), (0, "z", 5), (32768, "e", 6), (32769, "f", 7)],
        [(2, "again", 1), (3, "c", 2), (-5, "again", 3), (0, "again", 4), (big, "g", 5), (None, "null", 6)],
        [(32768, "again", 1), (32767, "h", 2), (big, "x", 3), (big, "y", 4), (5, "not -5", 5)],
    ]
    found = []
    for n, rows in enumerate(batches):
        conflicts = table.append(spark.createDataFrame(rows, schema), n)
        found.append(sorted(((r["id"], r["refused"], r["stored"]) for r in conflicts.collect()), key=str))
    assert found == [
        [(2, 1, False)], sorted([(-5, 1, True), (0, 1, True), (2, 1, True), (None, 1, False)], key=str),
        sorted([(32768, 1, True), (big, 2, True)], key=str),
    ]
    got = {r["id"]: r["content"] for r in table.rows().collect()}
    assert got == {1: "a", 2: "b", -5: "n", 0: "z", 32768: "e", 32769: "f", 3: "c", big: "g", 32767: "h", 5: "not -5"}
    assert table.append(spark.createDataFrame([(77, "x", 1)], schema), 2).count() == 2 and 77 not in {r["id"] for r in table.rows().collect()}
    with pytest.raises(NotUnique, match="1 rows of 1 ids"):
        table.append(spark.createDataFrame([(9, "new", 1), (3, "old", 2)], schema), 3, refuse=True)
    assert table.rows().where("id = 9").count() == 0
    assert table.append(spark.createDataFrame([(9, "new", 1)], schema), 3, refuse=True).count() == 0


def test_the_check_reads_the_index_and_not_the_table(spark, tmp_path):
    schema = spark.createDataFrame([], UNIQUE).schema
    table = UniqueTable(spark, str(tmp_path), schema, "log_offset")
    for n in range(3):
        table.append(spark.range(n * 100, n * 100 + 100).selectExpr("id", "'x' as content", "id as log_offset"), n)
    read = table.index(2).inputFiles()
    assert read and all("/index/" in f for f in read)


# Outbox.

def outbox_rows(spark, n, first=1, at=START - timedelta(hours=1)):
    messages = spark.range(first, first + n).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("m"), "id").alias("content"),
        (F.lit(at).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") % 1000).cast("decimal(18,6)"))).alias("created_at"),
    )
    return O.outbox_row(messages)


def accept(due):
    return due.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def written_rows(spark, root, batch):
    return sum(spark.read.parquet(str(p)).count() for p in root.glob(f"*/batch_id={batch}") if any(p.rglob("*.parquet")))


def test_a_poll_writes_what_it_takes_whatever_is_open(spark, tmp_path):
    none, written = spark.createDataFrame([], OUTBOX), []
    for n in (200, 20_000):
        root = tmp_path / str(n)
        store, queue = BatchStore(spark, str(root)), None
        for batch in range(4):
            queue = SO.poll(outbox_rows(spark, n) if batch == 0 else none, batch, store, accept, lambda: START, queue=queue)
        written.append([written_rows(spark, root, b) for b in (1, 2, 3)])
        assert SO.attempt_log(store).count() == 200
        assert SO.outbox_table(store).groupBy("status").count().orderBy("status").collect()[-1]["count"] == 200
    assert written == [[50, 50, 50]] * 2


def test_polls_over_many_batches_take_every_row_once(spark, tmp_path, monkeypatch):
    """Small segments, retries and merges; the queue is read anew from its markers now and then."""
    from tallypost.streaming import due_queue as Q

    monkeypatch.setattr(Q, "SEGMENT_ROWS", 40)
    monkeypatch.setattr(Q, "MOST_SMALL", 4)
    monkeypatch.setattr(Q, "WHOLE_EVERY", 3)
    store, queue, none, tried = BatchStore(spark, str(tmp_path)), None, spark.createDataFrame([], OUTBOX), []

    def flaky(due):
        rows = due.select("id", "retry_count", "next_retry_at").collect()
        tried.extend(r["id"] for r in rows)
        return spark.createDataFrame(
            [(r["id"], r["id"] < "8" or r["retry_count"] > 0, None if r["id"] < "8" else "no") for r in rows], "id string, ok boolean, error string"
        ) if rows else accept(due)

    for batch in range(16):
        fresh = outbox_rows(spark, 30, 1 + 30 * batch) if batch < 7 else none
        at = START + timedelta(seconds=batch)
        queue = SO.poll(fresh, batch, store, flaky, lambda: at, limit=25, queue=queue if batch % 3 else None)
        before = {k: s.rows for k, s in queue.segments.items()}
        assert {k: s.rows for k, s in DueQueue.after(store, batch).segments.items()} == before
        assert DueQueue.after(store, batch).rows().count() == sum(before.values())
    table = SO.outbox_table(store)
    assert table.count() == 210 and table.where("status <> 1").count() == 0
    again = {i for i in tried if i >= "8"}
    assert sorted(tried) == sorted([*{r["id"] for r in table.collect()}, *again]) and again


def test_a_poll_that_died_before_its_marker_leaves_nothing(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))

    def die(due):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        SO.poll(outbox_rows(spark, 60), 0, store, die, lambda: START)
    assert store.last_batch() == -1
    SO.poll(outbox_rows(spark, 60), 0, store, accept, lambda: START)
    assert SO.outbox_table(store).count() == 60 and SO.attempt_log(store).count() == 50


def test_dispatcher_uses_the_serializer(spark, tmp_path):
    """Payloads of another form are read by the pair they were written with."""
    from tallypost.functions import json_objects as J

    pipes = codec.Serializer(
        encode=lambda i, c, t: F.concat_ws("|", i.cast("string"), c).cast("binary"),
        decode=lambda v: J.outcome(
            F.instr(v.cast("string"), "|") > 0,
            F.struct(F.split_part(v.cast("string"), F.lit("|"), F.lit(1)).try_cast("int").alias("id"), F.split_part(v.cast("string"), F.lit("|"), F.lit(2)).alias("content")),
        ),
    )
    rows = O.outbox_row(
        spark.range(1, 5).select(F.col("id").cast("int").alias("id"), F.lit("c").alias("content"), F.lit(START).cast("timestamp").alias("created_at")), pipes
    ).withColumn("payload", F.when(F.col("payload").cast("string").startswith("4"), F.lit("broken").cast("binary")).otherwise(F.col("payload")))
    store = BatchStore(spark, str(tmp_path / "store"))
    SO.poll(rows, 0, store, SO.topic_dispatcher(serializer=pipes, fmt="parquet", path=str(tmp_path / "topic")), lambda: START)
    sent = spark.read.parquet(str(tmp_path / "topic")).select(codec.key_int(F.col("key")).alias("id")).collect()
    assert sorted(r["id"] for r in sent) == [1, 2, 3]
    assert [r["error"] for r in SO.attempt_log(store).where("not ok").collect()] == [SO.UNREADABLE]


def test_state_reads_only_tries_after_the_snapshot(spark, small, tmp_path):
    tries = as_stream_time(X.outbox_attempts(spark, small))
    messages = as_stream_time(X.messages(spark, small))
    log = AttemptLog(BatchStore(spark, str(tmp_path)), tries.schema)
    log.snapshot()
    for n in range(5):
        part = tries.where(F.pmod(F.xxhash64("id", "attempt_no"), F.lit(5)) == n)
        log.append(part, n)
        log.append(part, n)
        if n in (1, 3):
            log.snapshot()
            log.snapshot()
        seen = tries.where(F.pmod(F.xxhash64("id", "attempt_no"), F.lit(5)) <= n)
        expected = O.outbox_state(messages, seen)
        assert log.state(messages).exceptAll(expected).isEmpty() and expected.exceptAll(log.state(messages)).isEmpty()
    plan = log.merged()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(batch_id#\d+L?\).*batch_id#\d+L? > 3", plan)


# Positions and topics.

def changes(spark, low, high):
    return spark.range(low, high).select(
        (F.col("id") * 64).alias("wal_end"), F.lit("messages").alias("relation"),
        F.when(F.col("id") % 3 == 0, "commit").otherwise("insert").alias("kind"),
        F.col("id").cast("int").alias("id"), F.lit("c").alias("content"), F.lit(START).cast("timestamp").alias("created_at"),
    )


def test_a_slot_moves_behind_its_sink(spark, tmp_path):
    log, out, cp = (str(tmp_path / n) for n in ("log", "out", "cp"))
    handled = [0]
    for low in (1, 101, 201):
        slots.append_changes(changes(spark, low, low + 100).repartition(3), log)
        # a batch each, acknowledged when the next begins
        run_available(append_sink(slots.slot_stream(spark, log, "a"), out, cp))
        assert slots.acknowledged(spark, log, "a") == handled[-1]
        handled.append(read_sink(spark, out, changes(spark, 0, 1)).agg(F.max("wal_end")).first()[0])
    assert handled == [0, 6400, 12800, 19200]
    slots.append_changes(changes(spark, 301, 351), log)
    run_available(append_sink(slots.slot_stream(spark, log, "a"), out, cp))
    got = read_sink(spark, out, changes(spark, 0, 1))
    assert sorted(r["wal_end"] for r in got.collect()) == [64 * i for i in range(1, 351)]
    assert got.exceptAll(changes(spark, 1, 351)).isEmpty()
    # a new stream on the slot begins at what was acknowledged, another slot at the start
    run_available(append_sink(slots.slot_stream(spark, log, "a"), f"{out}2", f"{cp}2"))
    run_available(append_sink(slots.slot_stream(spark, log, "b"), f"{out}3", f"{cp}3"))
    second = read_sink(spark, f"{out}2", changes(spark, 0, 1))
    assert second.where(F.col("wal_end") <= slots.acknowledged(spark, log, "a")).count() == 0
    assert read_sink(spark, f"{out}3", changes(spark, 0, 1)).count() == 350
    with pytest.raises(ValueError, match="not behind the end"):
        slots.append_changes(changes(spark, 300, 310), log)


def records(spark, low, high):
    return codec.encode_records(spark.range(low, high).select(
        F.col("id").cast("int").alias("id"), F.lit("x").alias("content"), F.lit(START).cast("timestamp").alias("created_at")
    ))


def ids(spark, path):
    return sorted(codec.key_int(F.col("key")) is not None and r["id"] for r in committed.committed_records(spark, path).select(codec.key_int(F.col("key")).alias("id")).collect())


def test_a_task_that_fails_half_way_leaves_no_record(spark, tmp_path):
    source, topic, cp = (str(tmp_path / n) for n in ("in", "topic", "cp"))
    records(spark, 0, 40).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(records(spark, 0, 1).schema).parquet(source)
    failing = stream.withColumn("value", F.when(codec.key_int(F.col("key")) == 33, F.raise_error("broken").cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        run_available(committed.committed_topic(failing, topic, cp))
    assert committed.committed_records(spark, topic).count() == 0
    run_available(committed.committed_topic(stream, topic, cp))
    assert ids(spark, topic) == list(range(40))


def test_a_batch_that_is_written_again_adds_nothing(spark, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "topic")
    batch = pa.RecordBatch.from_pydict({"key": [b"\x00\x00\x00\x07"], "value": [b"v"], "topic": ["t"], "partition": pa.array([0], pa.int32()),
                                        "offset": [1], "timestamp": pa.array([START], pa.timestamp("us", "UTC"))})
    for _ in range(2):
        writer = committed._Writer({"path": path})
        writer.commit([writer.write(iter([batch, batch])), writer.write(iter([])), None], 3)
    assert ids(spark, path) == [7, 7]
    lost = committed._Writer({"path": path})
    lost.abort([lost.write(iter([batch]))], 4)
    assert ids(spark, path) == [7, 7] and len(list((tmp_path / "topic" / "data").iterdir())) == 1


def test_faulty_changes_are_told_from_good_ones(spark):
    good = '{"wal_end":64,"relation":"messages","kind":"insert","id":1,"content":"c","created_at":"2024-01-01T00:00:00Z"}'
    bad = ["{", '{"wal_end":"x","kind":"insert"}', '{"kind":"insert"}', '{"wal_end":1}', "[]", "", None]
    df = spark.createDataFrame([(v,) for v in [good, *bad, '{"wal_end":65,"kind":"commit"}']], "value string")
    rows, faults = change_sources.changes_from_topic(df)
    assert sorted((r["wal_end"], r["kind"], r["id"]) for r in rows.collect()) == [(64, "insert", 1), (65, "commit", None)]
    assert sorted(str(r["value"]) for r in faults.collect()) == sorted(map(str, bad))


# Counters and sketches.

def test_a_batch_that_reports_again_counts_once(spark, tmp_path):
    totals = SOb.ProgressTotals(spark, str(tmp_path), "n")
    for query, batch, n, low in (("q", 0, 5, 3), ("q", 0, 5, 3), ("q", 1, 7, 1), ("q", 1, 0, None), ("r", 0, 1, 9)):
        totals.keep(query, batch, {"0:requests:sum": n, "0:first:min": low, "0:last:max": None})
    assert totals.totals() == {"0:requests": 13, "0:first": 1, "0:last": None}
    assert totals.batches("q") == [0, 1]
    assert json.loads((tmp_path / "q" / f"{1:012d}.json").read_text())["0:requests:sum"] == 7


def test_sketches_merge_over_any_range(spark):
    n = F.col("id")
    df = spark.range(200_000).select(
        F.when(n % 4 == 0, "a").otherwise("b").alias("g"), F.when(n % 1000 == 7, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("v"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=n.cast("decimal(18,6)"))).alias("at"),
    )
    sliced = sketches.slices(df, ["g"], "v", "at")
    low, high = START + timedelta(hours=5), START + timedelta(hours=30)
    some = df.where((F.col("at") >= F.lit(low).cast("timestamp")) & (F.col("at") < F.lit(high).cast("timestamp")))
    got = sketches.merged(sliced, ["g"], low, high)
    assert {r["g"]: (r["slices"], r["n"]) for r in got.collect()} == {r["g"]: (25, r["n"]) for r in some.groupBy("g").agg(F.count("v").alias("n")).collect()}
    names = {"p1": 0.01, "med": 0.5, "p99": 0.99}
    quantiles = got.select("g", *[sketches.quantile(p).alias(k) for k, p in names.items()])
    checks = sketches.rank_bounds(some, ["g"], "v", quantiles, names).collect()
    assert len(checks) == 2 and all(r[f"{k}_ok"] for r in checks for k in names)
    off = quantiles.withColumn("med", F.col("p99"))
    assert not any(r["med_ok"] for r in sketches.rank_bounds(some, ["g"], "v", off, names).collect())
