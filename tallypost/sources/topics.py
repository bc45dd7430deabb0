"""Topic sources. `kafka` needs Spark's Kafka connector on the class path; any file
format over rows in the shape of `TOPIC_RECORD` can stand in for a broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CDC_CONSUMER_GROUP, CDC_TOPIC, CONSUMER_GROUP, MESSAGE_TOPIC, TOPIC_RECORD

RECORD_COLUMNS = TOPIC_RECORD.fieldNames()


def kafka_options(servers: str, topic: str, group: str, starting: str = "latest") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.group.id": group,
        "startingOffsets": starting,
    }


def _load(
    spark: SparkSession, topic: str, group: str, fmt: str, path: str | None, servers: str | None,
    stream: bool, options: dict[str, str],
) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format(fmt)
    if fmt == "kafka":
        starting = options.pop("startingOffsets", "latest" if stream else "earliest")
        return reader.options(**kafka_options(servers, topic, group, starting)).options(**options).load().select(
            *RECORD_COLUMNS
        )
    return reader.schema(TOPIC_RECORD).options(**options).load(path).where(F.col("topic") == topic)


def message_topic(
    spark: SparkSession, *, fmt: str = "kafka", path: str | None = None, servers: str | None = None,
    topic: str = MESSAGE_TOPIC, group: str = CONSUMER_GROUP, stream: bool = True, **options: str,
) -> DataFrame:
    """Records of the message topic: int key, JSON value."""
    return _load(spark, topic, group, fmt, path, servers, stream, options)


def cdc_topic(
    spark: SparkSession, *, fmt: str = "kafka", path: str | None = None, servers: str | None = None,
    topic: str = CDC_TOPIC, group: str = CDC_CONSUMER_GROUP, stream: bool = True, **options: str,
) -> DataFrame:
    """CDC envelopes as text; the key is not used."""
    records = _load(spark, topic, group, fmt, path, servers, stream, options)
    return records.select(
        F.col("offset").alias("log_offset"), F.col("value").cast("string").alias("value"), "timestamp"
    )
