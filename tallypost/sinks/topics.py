"""Topic sink. Spark's Kafka sink sets no record time, so the time of a message
travels in its value; a file sink in the shape of the source stands in for a broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import MESSAGE_TOPIC, TOPIC_RECORD

# Fixed value: every replica must confirm a record.
ACKS = "all"


def kafka_options(servers: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "kafka.acks": ACKS}


def addressed(records: DataFrame, topic: str = MESSAGE_TOPIC) -> DataFrame:
    """Give records their topic, unless each carries its own."""
    return records if "topic" in records.columns else records.withColumn("topic", F.lit(topic))


def file_records(records: DataFrame) -> DataFrame:
    """All columns of a topic record; a file has no partition or offset of its own."""
    have = set(records.columns)
    return records.select(*[
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in TOPIC_RECORD.fields
    ])


def write_topic(
    records: DataFrame, *, fmt: str = "kafka", path: str | None = None, servers: str | None = None,
    topic: str = MESSAGE_TOPIC,
) -> None:
    out = addressed(records, topic)
    if fmt == "kafka":
        out.select("key", "value", "topic").write.format("kafka").options(**kafka_options(servers)).save()
    else:
        file_records(out).write.format(fmt).mode("append").save(path)


def stream_topic(
    records: DataFrame, *, checkpoint: str, fmt: str = "kafka", path: str | None = None,
    servers: str | None = None, topic: str = MESSAGE_TOPIC,
) -> DataStreamWriter:
    out = addressed(records, topic)
    if fmt == "kafka":
        writer = out.select("key", "value", "topic").writeStream.format("kafka").options(**kafka_options(servers))
    else:
        writer = file_records(out).writeStream.format(fmt).option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")
