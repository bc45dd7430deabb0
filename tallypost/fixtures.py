"""Stand-in inputs derived from an `events` table.

They hold the awkward cases a constant message never shows: lost, late, repeated
and orphan deliveries, tombstones, deletes, retries and dead letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


# The five routes of the load test.
ENDPOINTS = ("/direct", "/naive", "/outbox", "/replication", "/debezium")


def _seconds(n: int):
    return F.expr(f"interval '{n}' second")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        (F.col("event_id").cast("int") + 1).alias("id"),
        F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("content"),
        F.col("ts").alias("created_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost: every 40th. Late by 90 s: every 7th. Sent twice: every 25th. Orphans: the negative of every 50th."""
    m = messages(spark, sf_dir)
    partition = (F.col("id") % 3).alias("log_partition")

    def at(step: int):
        return (F.col("id").cast("long") * 10 + step).alias("log_offset")

    delay = (
        F.when(F.col("id") % 7 == 0, _seconds(90)).when(F.col("id") % 3 == 0, _seconds(2)).otherwise(_seconds(45))
    )
    created = F.col("created_at")
    normal = m.where("id % 40 <> 0").select(
        "id", "content", created, (created + delay).alias("delivered_at"), partition, at(0)
    )
    again = m.where("id % 25 = 0 and id % 40 <> 0").select(
        "id", F.concat("content", F.lit("#dup")).alias("content"), created,
        (created + _seconds(100)).alias("delivered_at"), partition, at(1),
    )
    orphans = m.where("id % 50 = 0").select(
        (-F.col("id")).alias("id"), "content", created,
        (created + _seconds(5)).alias("delivered_at"), partition, at(2),
    )
    return normal.unionByName(again).unionByName(orphans)


def cdc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null value: every 33rd. Delete: every 10th. Updates, snapshot reads and inserts else."""
    id_ = F.col("id")
    op = F.when(id_ % 10 == 1, "u").when(id_ % 10 == 2, "r").otherwise("c")
    image = F.concat(
        F.lit('{"before":null,"after":{"id":'), id_.cast("string"), F.lit(',"content":"'), F.col("content"),
        F.lit('","created_at":"'), F.translate(F.col("created_at").cast("string"), " ", "T"),
        F.lit('Z"},"op":"'), op, F.lit('"}'),
    )
    return messages(spark, sf_dir).select(
        id_.cast("long").alias("log_offset"),
        F.when(id_ % 33 == 0, None)
        .when(id_ % 10 == 0, '{"before":null,"after":null,"op":"d"}')
        .otherwise(image).alias("value"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("id")
    kind = (
        F.when(id_ % 6 == 0, "begin").when(id_ % 6 == 1, "update").when(id_ % 6 == 2, "delete")
        .when(id_ % 6 == 3, "commit").otherwise("insert")
    )
    return messages(spark, sf_dir).select(
        (id_.cast("long") * 64).alias("wal_end"),
        F.when(id_ % 20 == 0, "OutboxMessages").otherwise("messages").alias("relation"),
        kind.alias("kind"),
        "id", "content", "created_at",
    )


def outbox_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three tries; id % 4 of them fail first. Every 9th id has none, some only their first."""
    id_, k = F.col("id"), F.col("attempt_no")
    tries = F.when(id_ % 11 == 5, 1).otherwise(F.least(id_ % 4 + 1, F.lit(3)))
    wait = F.when(k == 1, _seconds(1)).when(k == 2, _seconds(3)).otherwise(_seconds(7))
    return (
        messages(spark, sf_dir).where("id % 9 <> 8")
        .select("id", "created_at", F.explode(F.sequence(F.lit(1), tries)).alias("attempt_no"))
        .select(
            "id", "attempt_no",
            (F.col("created_at") + wait).alias("attempted_at"),
            (k > id_ % 4).alias("ok"),
            F.when(k > id_ % 4, None).otherwise(F.concat(F.lit("broker error "), k.cast("string"))).alias("error"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load-test samples; the five event types stand for the five endpoints. Status 0: no answer."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(kind == "view", "/direct").when(kind == "click", "/naive").when(kind == "signup", "/outbox")
        .when(kind == "purchase", "/replication").otherwise("/debezium").alias("endpoint"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 97 == 0, 500).when(F.col("event_id") % 193 == 0, 0).otherwise(201).alias("status_code"),
        (F.col("event_id") % 101 == 0).alias("warmup"),
        (F.col("event_id") % 250).cast("int").alias("vus"),
    )


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wait per message, of 15, 30 or 60 s; every fifth begins 20 s after the write."""
    id_ = F.col("id")
    later = F.when(id_ % 5 == 0, _seconds(20)).otherwise(_seconds(0))
    return messages(spark, sf_dir).select(
        "id", (F.col("created_at") + later).alias("waited_at"),
        F.when(id_ % 3 == 0, 15).when(id_ % 3 == 1, 30).otherwise(60).alias("wait_seconds"),
    )


def cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth wait is cancelled 10 s after the write, some before they begin."""
    return messages(spark, sf_dir).where("id % 8 = 0").select("id", (F.col("created_at") + _seconds(10)).alias("cancelled_at"))
