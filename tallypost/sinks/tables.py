"""Appending to the message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MESSAGE

# Fixed value: connections the database allows.
DATABASE_CONNECTIONS = 110


def append_messages(messages: DataFrame, path: str, fmt: str = "parquet") -> None:
    messages.select(MESSAGE.fieldNames()).write.format(fmt).mode("append").save(path)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(MESSAGE).load(path)


def append_messages_jdbc(
    messages: DataFrame, url: str, table: str = "messages", connections: int = DATABASE_CONNECTIONS,
    **options: str,
) -> None:
    """The same over JDBC, with no more writers than the database has connections."""
    (
        messages.select(MESSAGE.fieldNames()).write.format("jdbc")
        .options(url=url, dbtable=table, numPartitions=str(connections), **options)
        .mode("append").save()
    )
