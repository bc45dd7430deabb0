"""Named queries: every operator over the whole of the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import partial
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixtures as X
from ..functions import codec, names, sketches
from ..operators import changes as C, delivery as D, ingest as I, metrics as M, outbox as O, quality as Q
from ..schemas import CDC_TOPIC, MESSAGE_TOPIC, OUTBOX, TYPE_NAME, TYPE_NAME_LIMIT, WAIT_SECONDS
from ..session import prepare, side_by_side, stage, workspace
from ..sinks import committed, report, tables, topics as topic_sinks
from ..sinks.batches import BatchStore
from ..sinks.ledger import IdLedger
from ..sinks.unique import UniqueTable
from ..sources import changes as change_sources, landing, slots, topics as topic_sources
from ..streaming import delivery as SD, ingest as SI, observed as SOb, outbox as SO, quarantine as SQ, waits as SW
from ..streaming.attempts import AttemptLog
from ..streaming.run import append_sink, read_sink, run_available, slice_between, time_cuts
from . import routes
from .replays import Landing, as_stream_time, run_over

Query = Callable[[SparkSession, str], DataFrame]

CLOCK = datetime(2024, 2, 1)
# Inside the time range of the tables, so that some rows are due and some are not.
POLL_AT = datetime(2024, 1, 20)

QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    """Register under the function's name; times come out as stored, without a zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(prepare(spark), sf_dir)
        zoned = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
        return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out

    QUERIES[build.__name__] = run
    return run


def _clock():
    return F.lit(CLOCK).cast("timestamp")


def _streamed(spark: SparkSession, label: str, df: DataFrame) -> DataFrame:
    """Run a stateless stream to its end and read what it wrote."""
    root = workspace(spark, label)
    run_available(append_sink(df, f"{root}/out", f"{root}/checkpoint"))
    return read_sink(spark, f"{root}/out", df)


# Records on the wire, made from the tables.

def _delivery_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = X.deliveries(spark, sf_dir)
    return deliveries.select(
        codec.key_bytes(F.col("id")).alias("key"),
        codec.message_json(F.col("id"), F.col("content"), F.col("created_at")).cast("binary").alias("value"),
        F.lit(MESSAGE_TOPIC).alias("topic"),
        F.col("log_partition").alias("partition"),
        F.col("log_offset").alias("offset"),
        F.col("delivered_at").cast("timestamp").alias("timestamp"),
    )


def _cdc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cdc_log(spark, sf_dir).select(
        F.col("value").cast("binary").alias("value"), F.lit(CDC_TOPIC).alias("topic"),
        F.col("log_offset").alias("offset"),
    )


def _landed(spark: SparkSession, label: str, records: DataFrame) -> str:
    path = workspace(spark, label)
    topic_sinks.file_records(records).write.parquet(path)
    return path


# Sources.

@_query
def topic_source(spark, sf_dir):
    path = _landed(spark, "topic", _delivery_records(spark, sf_dir))
    decoded = codec.decode_records(topic_sources.message_topic(spark, fmt="parquet", path=path))
    good, _ = codec.split_malformed(decoded)
    return _streamed(spark, "topic-source", good.select(
        "id", "message.content", "message.created_at",
        F.col("partition").alias("log_partition"), F.col("offset").alias("log_offset"),
    ))


@_query
def cdc_source(spark, sf_dir):
    path = _landed(spark, "cdc", _cdc_records(spark, sf_dir))
    log = topic_sources.cdc_topic(spark, fmt="parquet", path=path).select("log_offset", "value")
    return _streamed(spark, "cdc-source", C.cdc_after_image(C.drop_tombstones(log)))


@_query
def change_source(spark, sf_dir):
    path = workspace(spark, "changes")
    as_stream_time(X.change_log(spark, sf_dir)).write.parquet(path)
    return _streamed(spark, "change-source", change_sources.change_stream(spark, path))


@_query
def ingest_source(spark, sf_dir):
    path = workspace(spark, "bodies")
    X.messages(spark, sf_dir).select("id", "content").write.json(path)
    return _streamed(spark, "ingest-source", landing.accepted(landing.bodies(spark, path)))


# Sinks.

@_query
def message_append(spark, sf_dir):
    path = workspace(spark, "message-table")
    tables.append_messages(as_stream_time(X.messages(spark, sf_dir)), path)
    return tables.read_messages(spark, path)


@_query
def topic_sink(spark, sf_dir):
    path = workspace(spark, "topic-out")
    topic_sinks.write_topic(codec.encode_records(X.messages(spark, sf_dir)), fmt="parquet", path=path)
    good, _ = codec.split_malformed(codec.decode_records(
        topic_sources.message_topic(spark, fmt="parquet", path=path, stream=False)
    ))
    return good.select("id", "message.content", "message.created_at", "topic", "timestamp")


@_query
def outbox_cowrite(spark, sf_dir):
    """Ids on both sides after an ingest stream, and whether the payload equals the row."""
    root = workspace(spark, "cowrite")
    X.messages(spark, sf_dir).select("content").write.json(f"{root}/bodies")
    store = BatchStore(spark, f"{root}/store")
    read = landing.accepted(landing.bodies(spark, f"{root}/bodies"))
    run_available(SI.ingest(read, store, f"{root}/checkpoint", clock=_clock(), outbox=True))
    payload = SI.stored_outbox(store).select(
        F.explode(F.array(codec.parse_message(F.col("payload").cast("string")))).alias("p")
    ).select(F.col("p.value.id").alias("outbox_message_id"), F.col("p.value.content").alias("payload_content"))
    rows = SI.stored_messages(store)
    return rows.join(payload, rows["id"] == payload["outbox_message_id"], "full_outer").select(
        "id", "outbox_message_id", (F.col("content") == F.col("payload_content")).alias("same_content")
    )


@_query
def summary_report(spark, sf_dir):
    path = workspace(spark, "summary")
    built = report.summary(X.requests(spark, sf_dir))
    report.write_summary(built, path)
    return report.figures(report.read_summary(spark, path, built))


# Projections, filters, scalar work.

@_query
def stamp_message(spark, sf_dir):
    return I.stamp(X.messages(spark, sf_dir), _clock())


@_query
def assign_id(spark, sf_dir):
    return I.assign_id(X.messages(spark, sf_dir).select("content", "created_at")).select("id")


@_query
def rename_columns(spark, sf_dir):
    return names.to_camel(X.messages(spark, sf_dir))


@_query
def encode_record(spark, sf_dir):
    return codec.encode_records(X.messages(spark, sf_dir)).select(
        F.hex("key").alias("key_hex"), F.col("value").cast("string").alias("value"), "timestamp"
    )


@_query
def decode_record(spark, sf_dir):
    """Values as other writers may send them: other case, quoted numbers, missing, null, broken."""
    id_ = F.col("id")
    quoted = F.concat(F.lit('"'), F.col("content"), F.lit('"'))
    at = F.date_format(F.col("created_at").cast("timestamp"), codec.JSON_TIME)

    def document(id_name, id_text, content_name, time_name):
        return F.concat(
            F.lit(f'{{"{id_name}":'), id_text, F.lit(f',"{content_name}":'), quoted,
            F.lit(f',"{time_name}":"'), at, F.lit('"}'),
        )

    value = (
        F.when(id_ % 13 == 0, None)
        .when(id_ % 11 == 0, F.concat(F.lit('{"id":'), id_.cast("string")))
        .when(id_ % 7 == 0, document("ID", id_.cast("string"), "Content", "CREATEDAT"))
        .when(id_ % 5 == 0, document("id", F.concat(F.lit('"'), id_.cast("string"), F.lit('"')), "content", "createdAt"))
        .when(id_ % 3 == 0, F.concat(F.lit('{"id":'), id_.cast("string"), F.lit(',"createdAt":"'), at, F.lit('"}')))
        .otherwise(document("id", id_.cast("string"), "content", "createdAt"))
    )
    records = X.messages(spark, sf_dir).select(
        codec.key_bytes(id_).alias("key"), value.cast("binary").alias("value")
    )
    return codec.decode_records(records).select(
        "id", F.col("message.id").alias("message_id"), "message.content", "message.created_at", "malformed"
    )


@_query
def outbox_row(spark, sf_dir):
    return O.outbox_row(X.messages(spark, sf_dir)).withColumn("payload", F.col("payload").cast("string"))


@_query
def cdc_after_image(spark, sf_dir):
    return C.cdc_after_image(X.cdc_log(spark, sf_dir))


@_query
def insert_only(spark, sf_dir):
    return C.insert_only(X.change_log(spark, sf_dir))


@_query
def drop_tombstones(spark, sf_dir):
    return C.drop_tombstones(X.cdc_log(spark, sf_dir))


@_query
def project_by_name(spark, sf_dir):
    """Columns in another order, one unknown, one missing."""
    rows = X.change_log(spark, sf_dir).select("content", "relation", "id")
    return C.project_by_name(rows, now=_clock())


@_query
def table_filter(spark, sf_dir):
    return C.table_filter(X.change_log(spark, sf_dir))


@_query
def skip_snapshot(spark, sf_dir):
    return C.skip_snapshot(X.cdc_log(spark, sf_dir))


@_query
def topic_route(spark, sf_dir):
    return C.topic_route(X.change_log(spark, sf_dir)).select("wal_end", "topic")


@_query
def path_filter(spark, sf_dir):
    id_ = F.col("request_id")
    path = (
        F.when(id_ % 13 == 0, "/health").when(id_ % 17 == 0, "/alive/x").when(id_ % 19 == 0, "/healthy")
        .otherwise(F.col("endpoint"))
    )
    return M.path_filter(X.requests(spark, sf_dir).select("request_id", path.alias("path")))


@_query
def constraint_check(spark, sf_dir):
    shared = ("content", "created_at")
    typed = X.messages(spark, sf_dir).withColumn("type_name", F.lit(TYPE_NAME))
    arrived = X.deliveries(spark, sf_dir).withColumn("type_name", F.col("content"))
    checks = {
        name: Q.constraint_check(df, "id", shared, {"type_name": TYPE_NAME_LIMIT})
        for name, df in (("messages", typed), ("deliveries", arrived))
    }
    named = [df.select(F.lit(name).alias("relation"), "*") for name, df in checks.items()]
    return D.merge_producers(*named)


# Joins and set operations.

@_query
def delivery_match(spark, sf_dir):
    return D.delivery_match(X.messages(spark, sf_dir), D.first_delivery(X.deliveries(spark, sf_dir)))


@_query
def undelivered(spark, sf_dir):
    return D.undelivered(X.messages(spark, sf_dir), X.deliveries(spark, sf_dir))


@_query
def orphan_deliveries(spark, sf_dir):
    return D.orphan_deliveries(X.messages(spark, sf_dir), X.deliveries(spark, sf_dir))


@_query
def delivery_status(spark, sf_dir):
    return D.delivery_status(X.messages(spark, sf_dir), X.deliveries(spark, sf_dir))


@_query
def delivery_status_counts(spark, sf_dir):
    return D.status_counts(delivery_status(spark, sf_dir))


def _producers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All messages, by who produces them."""
    m = X.messages(spark, sf_dir)
    click = F.coalesce(F.col("content").startswith("click:"), F.lit(False))
    return {"click": m.where(click), "other": m.where(~click)}


@_query
def producer_union(spark, sf_dir):
    """Two producers, told apart by what the content starts with, feed one topic."""
    parts = [
        codec.encode_records(m).withColumn("producer", F.lit(name)) for name, m in _producers(spark, sf_dir).items()
    ]
    return D.merge_producers(*parts).select(
        codec.key_int(F.col("key")).alias("id"), F.col("value").cast("string").alias("value"), "timestamp", "producer"
    )


# Aggregations.

@_query
def latency_trend(spark, sf_dir):
    return M.latency_trend(X.requests(spark, sf_dir))


@_query
def expected_latency(spark, sf_dir):
    return M.expected_latency(X.requests(spark, sf_dir))


@_query
def check_rate(spark, sf_dir):
    return M.check_rate(M.run_totals(X.requests(spark, sf_dir)))


@_query
def request_counter(spark, sf_dir):
    return M.request_counter(M.run_totals(X.requests(spark, sf_dir)))


@_query
def vus_gauge(spark, sf_dir):
    return M.vus_gauge(M.run_totals(X.requests(spark, sf_dir)))


@_query
def failure_threshold(spark, sf_dir):
    return M.failure_threshold(M.run_totals(X.requests(spark, sf_dir)))


@_query
def net_throughput(spark, sf_dir):
    return M.net_throughput(M.run_totals(X.requests(spark, sf_dir)))


@_query
def wal_position(spark, sf_dir):
    return C.acknowledged_position(X.change_log(spark, sf_dir))


# Delivery order and outbox.

@_query
def first_delivery(spark, sf_dir):
    return D.first_delivery(X.deliveries(spark, sf_dir))


@_query
def outbox_state(spark, sf_dir):
    return O.outbox_state(X.messages(spark, sf_dir), X.outbox_attempts(spark, sf_dir))


@_query
def outbox_batch(spark, sf_dir):
    return O.outbox_batch(outbox_state(spark, sf_dir), F.lit(POLL_AT).cast("timestamp_ntz"))


def _outbox_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows as they stand after the logged attempts, keyed by message id."""
    state = as_stream_time(O.outbox_state(X.messages(spark, sf_dir), X.outbox_attempts(spark, sf_dir)))
    payload = as_stream_time(X.messages(spark, sf_dir)).select(
        "id", codec.message_json(F.col("id"), F.col("content"), F.col("created_at")).cast("binary").alias("payload")
    )
    return state.join(payload, "id").select(
        F.col("id").cast("string").alias("id"), F.lit(TYPE_NAME).alias("type_name"), "payload",
        *[F.col(c) for c in OUTBOX.fieldNames()[3:]],
    )


def _flaky(sink):
    """Refuses every fifth message, produces the others."""

    def dispatch(due: DataFrame) -> DataFrame:
        refused = F.col("id").cast("int") % 5 == 0
        sent = sink(due.where(~refused))
        lost = due.where(refused).select("id", F.lit(False).alias("ok"), F.lit("refused").alias("error"))
        return sent.unionByName(lost)

    return dispatch


def _dispatched(spark: SparkSession, sf_dir: str) -> tuple[BatchStore, str]:
    root = workspace(spark, "dispatch")
    topic = f"{root}/topic"
    _outbox_table(spark, sf_dir).write.parquet(f"{root}/rows")
    rows = spark.readStream.schema(OUTBOX).parquet(f"{root}/rows")
    store = BatchStore(spark, f"{root}/store")
    dispatcher = _flaky(SO.topic_dispatcher(fmt="parquet", path=topic))
    run_available(SO.dispatch(
        rows, store, f"{root}/checkpoint", dispatcher, clock=lambda: POLL_AT, limit=None
    ))
    return store, topic


@_query
def outbox_dispatch(spark, sf_dir):
    """The outbox after one poll over the whole table: sent, to be retried or dead."""
    store, _ = _dispatched(spark, sf_dir)
    return SO.outbox_table(store).select(
        F.col("id").cast("int").alias("id"), "status", "retry_count", "next_retry_at", "processed_at",
        "dead_letter_error",
    )


@_query
def outbox_dispatch_topic(spark, sf_dir):
    """What the same poll put on the topic."""
    _, topic = _dispatched(spark, sf_dir)
    good, _ = codec.split_malformed(codec.decode_records(
        topic_sources.message_topic(spark, fmt="parquet", path=topic, stream=False)
    ))
    return good.select("id", "message.content", "message.created_at")


# Streams with state.

@_query
def first_delivery_stream(spark, sf_dir):
    return run_over(
        spark, "first-delivery", {"deliveries": (X.deliveries(spark, sf_dir), "delivered_at")},
        lambda deliveries: SD.first_delivery_stream(deliveries),
    )


def _status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(
        spark, "delivery-status",
        {
            "messages": (X.messages(spark, sf_dir), "created_at"),
            "deliveries": (X.deliveries(spark, sf_dir), "delivered_at"),
        },
        SD.delivery_status_stream,
    )


@_query
def delivery_match_stream(spark, sf_dir):
    met = _status_stream(spark, sf_dir).where(F.col("status") == "confirmed")
    return met.select("id", "content", F.col("written_at").alias("created_at"), "delivered_at")


@_query
def delivery_status_stream(spark, sf_dir):
    return _status_stream(spark, sf_dir).drop("content")


@_query
def rendezvous_stream(spark, sf_dir):
    """The prompt form: writes and what met them in time."""
    return run_over(
        spark, "rendezvous",
        {
            "messages": (X.messages(spark, sf_dir), "created_at"),
            "deliveries": (X.deliveries(spark, sf_dir), "delivered_at"),
        },
        SD.rendezvous,
    )


def _waited(spark: SparkSession, sf_dir: str, mixed: bool) -> DataFrame:
    """Waits with bounds of their own; `mixed` rows come in an order that has nothing to do with their times."""
    tables = {
        "waits": (X.waits(spark, sf_dir), "waited_at"), "events": (X.deliveries(spark, sf_dir), "delivered_at"),
        "cancellations": (X.cancellations(spark, sf_dir), "cancelled_at"),
    }
    if not mixed:
        return run_over(spark, "waits", tables, SW.waits_stream, slices=1)
    low, high = X.messages(spark, sf_dir).agg(F.min("created_at"), F.max("created_at")).first()
    span = (high - low if low else timedelta()) + timedelta(days=1)
    place = F.pmod(F.xxhash64("id", F.lit("arrival")), F.lit(1_000_000)) / 1_000_000
    arrival = F.lit(low).cast("timestamp_ntz") + F.make_dt_interval(secs=(place * span.total_seconds()).cast("decimal(18,6)"))
    tables = {name: (df.withColumn("arrived_at", arrival), "arrived_at") for name, (df, _) in tables.items()}
    # nothing is late, however it comes; the end record lies beyond the delay
    return run_over(
        spark, "waits-mixed", tables, lambda **t: SW.waits_stream(**t, delay=f"{span.days + 1} days", keep=3600),
        end_gap=2 * span + timedelta(days=2),
    )


@_query
def waits_stream(spark, sf_dir):
    """Met, expired or cancelled: the same for two orders of arrival."""
    by_arrival = {"in order": False, "mixed": True}
    waited = side_by_side(spark, (partial(_waited, spark, sf_dir, mixed) for mixed in by_arrival.values()))
    return D.merge_producers(*[df.withColumn("arrival", F.lit(name)) for name, df in zip(by_arrival, waited)])


@_query
def open_writes(spark, sf_dir):
    """Who is waiting at a moment: read from the state of a stream that stopped then."""
    root = workspace(spark, "open-writes")
    sides = {"messages": (X.messages(spark, sf_dir), "created_at"), "deliveries": (X.deliveries(spark, sf_dir), "delivered_at")}
    streams = {}
    for name, (df, arrival) in sides.items():
        landing = Landing(df.where(F.col(arrival) < F.lit(POLL_AT)), arrival, f"{root}/{name}")
        landing.land([], 0)
        streams[name] = landing.stream()
    # a delay that keeps everything in state
    status = SD.delivery_status_stream(**streams, delay="3650 days", gap="3 minutes")
    run_available(append_sink(status, f"{root}/out", f"{root}/checkpoint"))
    return SD.open_writes(spark, f"{root}/checkpoint")


@_query
def producer_union_stream(spark, sf_dir):
    """Two producers on one stream, each with its own watermark; the second is an hour behind."""
    sides = _producers(spark, sf_dir)
    hour = F.expr("interval '1' hour")
    tables = {
        "click": (sides["click"].withColumn("sent_at", F.col("created_at")), "sent_at"),
        "other": (sides["other"].withColumn("sent_at", F.col("created_at") + hour), "sent_at"),
    }
    return run_over(spark, "producers", tables, SD.union_of_producers, slices=3)


@_query
def resume_from_checkpoint(spark, sf_dir):
    """Four runs over four slices on one checkpoint: no record lost, none doubled."""
    return run_over(
        spark, "resume", {"deliveries": (X.deliveries(spark, sf_dir), "delivered_at")},
        lambda deliveries: deliveries, slices=4,
    )


# Polls, positions and keys that are kept between batches.

@_query
def outbox_polls(spark, sf_dir):
    """The outbox after polls as they are by default: 50 rows, 3 tries, 100 ms apart."""
    root = workspace(spark, "polls")
    _outbox_table(spark, sf_dir).write.parquet(f"{root}/rows")
    store = BatchStore(spark, f"{root}/store")
    dispatcher = _flaky(SO.topic_dispatcher(fmt="parquet", path=f"{root}/topic"))
    rows, none, queue = spark.read.schema(OUTBOX).parquet(f"{root}/rows"), spark.createDataFrame([], OUTBOX), None
    for n in range(8):
        moment = POLL_AT + n * timedelta(milliseconds=100)
        queue = SO.poll(none if n else rows, n, store, dispatcher, lambda: moment, queue=queue)
    return SO.outbox_table(store).select(
        F.col("id").cast("int").alias("id"), "status", "retry_count", "next_retry_at", "processed_at",
        "dead_letter_error",
    )


@_query
def outbox_state_snapshot(spark, sf_dir):
    """State from a snapshot after half of the batches, one of them sent twice, and the batches since."""
    root = workspace(spark, "attempts")
    tries = as_stream_time(X.outbox_attempts(spark, sf_dir))
    log = AttemptLog(BatchStore(spark, root), tries.schema)
    cuts = time_cuts(tries, "attempted_at", 4)
    for n in range(len(cuts) + 1):
        part = slice_between(tries, "attempted_at", cuts, n)
        log.append(part, n)
        log.append(part, n)
        if n == 1:
            log.snapshot()
    return log.state(as_stream_time(X.messages(spark, sf_dir)))


def _slot_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int, bool]]]:
    """A reader that stops in the middle of a log and goes on: what it read, and (run, handled, not ahead)."""
    root = workspace(spark, "slot")
    log = as_stream_time(X.change_log(spark, sf_dir))
    early = F.col("created_at") < F.lit(POLL_AT).cast("timestamp")
    runs = []
    for run, part in enumerate((log.where(early), log.where(~early)), 1):
        slots.append_changes(part, f"{root}/log")
        stream = slots.slot_stream(spark, f"{root}/log", "rep_slot")
        run_available(append_sink(stream, f"{root}/out", f"{root}/checkpoint"))
        handled = read_sink(spark, f"{root}/out", log).agg(F.max("wal_end")).first()[0]
        runs.append((run, handled, slots.acknowledged(spark, f"{root}/log", "rep_slot") <= (handled or 0)))
    return read_sink(spark, f"{root}/out", log), runs


@_query
def change_slot(spark, sf_dir):
    """Inserted messages read through a slot in two runs; changes of every kind moved its position."""
    read, _ = _slot_runs(spark, sf_dir)
    return C.project_by_name(C.table_filter(C.insert_only(read)), keep=("wal_end",))


@_query
def change_slot_position(spark, sf_dir):
    """After each run, what was handled, and whether the acknowledged position is no further."""
    _, runs = _slot_runs(spark, sf_dir)
    return spark.createDataFrame(runs, "run int, handled long, not_ahead boolean")


@_query
def two_writer_ids(spark, sf_dir):
    """Two ingest streams number into one table by a ledger; a batch of each is sent again."""
    root = workspace(spark, "writers")
    ledger = IdLedger(spark, f"{root}/ledger", size=512)
    stores, again = {}, {}
    for name, m in _producers(spark, sf_dir).items():
        stores[name], bodies = BatchStore(spark, f"{root}/{name}"), m.select("content")
        for n, part in enumerate(bodies.randomSplit([1.0, 1.0, 1.0], seed=7)):
            SI.write_batch(part, n, stores[name], _clock(), writer=(ledger, name))
        stored = SI.stored_messages(stores[name]).where("batch_id = 1").select("id", "content")
        repeated = ledger.assign(I.stamp(stage(bodies.limit(0), "none"), _clock()), name, 1).select("id", "content")
        again[name] = stored.exceptAll(repeated).isEmpty() and repeated.exceptAll(stored).isEmpty()
    tables = [SI.stored_messages(store).select(F.lit(name).alias("stream"), "id") for name, store in stores.items()]
    every = D.merge_producers(*tables)
    total, distinct = every.agg(F.count("id"), F.count_distinct("id")).first()
    repeated = F.when(F.col("stream") == "click", again["click"]).otherwise(again["other"])
    return every.groupBy("stream").agg(F.count("*").alias("messages"), F.count_distinct("id").alias("ids")).select(
        "*", F.lit(total == distinct).alias("unique_overall"), repeated.alias("same_when_repeated")
    )


@_query
def append_constraint(spark, sf_dir):
    """Conflicting ids of four batches, found before each became visible."""
    rows = as_stream_time(X.deliveries(spark, sf_dir))
    table = UniqueTable(spark, workspace(spark, "unique"), rows.schema, "log_offset")
    batch = F.when((F.col("log_offset") % 10 == 1) & (F.col("id") % 2 == 1), 3).otherwise(F.abs("id") % 3)
    for n in range(4):
        table.append(rows.where(batch == n), n)
    return table.conflicts().select("batch_id", F.col("id").cast("int").alias("id"), "refused", "stored")


@_query
def latency_sketch(spark, sf_dir):
    """Quantiles from sketches per hour, merged; true where the exact rank is within the stated error."""
    requests = X.requests(spark, sf_dir)
    sliced = stage(sketches.slices(requests, ["endpoint"], "duration_ms", "started_at"), "sketches")
    whole = sketches.merged(sliced, ["endpoint"]).select(
        "endpoint", "slices", "n", *[sketches.quantile(p).alias(name) for name, p in M.TREND_QUANTILES.items()]
    )
    whole = stage(whole, "sketch-quantiles")
    checks = sketches.rank_bounds(requests, ["endpoint"], "duration_ms", whole.drop("n", "slices"), M.TREND_QUANTILES)
    return whole.select("endpoint", "n", "slices").join(checks, "endpoint")


@_query
def observed_counters(spark, sf_dir):
    """Counters and rates from what a stream reported batch by batch, over restarts; no second pass."""
    root = workspace(spark, "observed")
    landing = Landing(X.requests(spark, sf_dir), "started_at", f"{root}/in")
    cuts = time_cuts(landing.df, "started_at", 3)
    totals = SOb.ProgressTotals(spark, f"{root}/totals", "requests")
    measures = SOb.route_measures(X.ENDPOINTS)
    for n in range(len(cuts) + 2):  # the last run finds nothing
        if n <= len(cuts):
            landing.land(cuts, n)
        seen = SOb.observed(landing.stream(), "requests", measures)
        SOb.run_counted(append_sink(seen, f"{root}/out", f"{root}/checkpoint"), totals)
    return SOb.route_report(spark, totals.totals(), X.ENDPOINTS)


@_query
def topic_commit(spark, sf_dir):
    """Records produced by a stream whose batches are committed as a whole, read back and decoded."""
    root = workspace(spark, "topic-commit")
    landing = Landing(X.messages(spark, sf_dir), "created_at", f"{root}/in")
    cuts = time_cuts(landing.df, "created_at", 2)
    for n in range(len(cuts) + 1):
        landing.land(cuts, n)
        run_available(committed.committed_topic(codec.encode_records(landing.stream()), f"{root}/topic", f"{root}/checkpoint"))
    good, _ = codec.split_malformed(codec.decode_records(committed.committed_records(spark, f"{root}/topic")))
    return good.select("id", "message.content", "message.created_at")


@_query
def faulty_records(spark, sf_dir):
    """A topic with broken values, split by a stream into what could be read and a quarantine."""
    root = workspace(spark, "faulty")
    records = codec.encode_records(X.messages(spark, sf_dir))
    broken = F.substring("value", 1, 9)
    records = records.withColumn("value", F.when(codec.key_int(F.col("key")) % 7 == 0, broken).otherwise(F.col("value")))
    topic_sinks.write_topic(records, fmt="parquet", path=f"{root}/topic")
    store = BatchStore(spark, f"{root}/store")
    read = codec.decode_records(topic_sources.message_topic(spark, fmt="parquet", path=f"{root}/topic"))
    run_available(SQ.split_stream(read, store, f"{root}/checkpoint"))
    # what lands is as decoded: the quarantine keeps key and value as they came
    good, bad = (part.limit(0) for part in codec.split_malformed(codec.decode_records(
        topic_sources.message_topic(spark, fmt="parquet", path=f"{root}/topic", stream=False))))
    kept = store.table(SQ.GOOD, good.schema).select("id", F.lit("good").alias("place"), "message.content")
    left = store.table(SQ.QUARANTINE, bad.schema).select(
        codec.key_int(F.col("key")).alias("id"), F.lit("quarantine").alias("place"), F.lit(None).cast("string").alias("content")
    )
    return kept.unionByName(left)


@_query
def ingest_route(spark, sf_dir):
    """Posted bodies from end to end: stored, produced to the topic, read back, and matched with their waits."""
    root = workspace(spark, "ingest-route")
    X.messages(spark, sf_dir).select("content").write.json(f"{root}/bodies")
    store = BatchStore(spark, f"{root}/store")

    def produce(stored: DataFrame) -> None:
        topic_sinks.write_topic(codec.encode_records(stored), fmt="parquet", path=f"{root}/topic")

    bodies = landing.accepted(landing.bodies(spark, f"{root}/bodies"))
    run_available(SI.ingest(bodies, store, f"{root}/checkpoint", clock=_clock(), produce=produce))
    arrived = routes.topic_deliveries(topic_sources.message_topic(spark, fmt="parquet", path=f"{root}/topic", stream=False))
    events = arrived.withColumn("log_offset", F.coalesce("log_offset", F.lit(0))).select("id", "content", "delivered_at", "log_offset")
    asked = SI.stored_messages(store).select("id", F.col("created_at").alias("waited_at"), F.lit(WAIT_SECONDS).alias("wait_seconds"))
    met = run_over(
        spark, "ingest-waits", {"waits": (asked, "waited_at"), "events": (events, "delivered_at")}, SW.waits_stream
    )
    return met.groupBy("content", "result").agg(F.count("*").alias("messages"))


# Routes from end to end.

@_query
def direct_route(spark, sf_dir):
    return routes.table_only(message_append(spark, sf_dir))


@_query
def naive_route(spark, sf_dir):
    return routes.dual_write(
        as_stream_time(X.messages(spark, sf_dir)), topic_sinks.file_records(_delivery_records(spark, sf_dir))
    )


@_query
def outbox_route(spark, sf_dir):
    table = _outbox_table(spark, sf_dir)
    return routes.outbox(X.messages(spark, sf_dir), table.select("id", "payload"), table)


@_query
def replication_route(spark, sf_dir):
    return routes.replication(X.messages(spark, sf_dir), X.change_log(spark, sf_dir))


@_query
def cdc_route(spark, sf_dir):
    return routes.cdc(X.messages(spark, sf_dir), X.cdc_log(spark, sf_dir))
