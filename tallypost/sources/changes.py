"""Logical change source: landed change rows, each with its end position in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CHANGE


def change_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = True, **options: str
) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(CHANGE).options(**options).load(path)


def decode_changes(records: DataFrame) -> DataFrame:
    """Add the columns of a change to records that hold one as JSON, and `malformed`.

    Malformed is what is no JSON, holds a value of another type, or lacks its position or kind.
    The parse runs in a generator, which Catalyst does not copy into later filters.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHANGE.fields) + ", _bad string"
    parsed = F.from_json(F.col("value").cast("string"), fields, {"columnNameOfCorruptRecord": "_bad"})
    read = records.select("*", F.explode(F.array(parsed)).alias("_change"))
    bad = F.col("_change").isNull() | F.col("_change._bad").isNotNull() | F.col("_change.wal_end").isNull() | F.col("_change.kind").isNull()
    return read.select(*records.columns, *[F.col(f"_change.{f.name}").alias(f.name) for f in CHANGE.fields], bad.alias("malformed"))


def changes_from_topic(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change rows that were put on a topic as JSON values, and the records that hold none."""
    decoded = decode_changes(records)
    return (
        decoded.where(~F.col("malformed")).select(CHANGE.fieldNames()),
        decoded.where("malformed").select(records.columns),
    )
