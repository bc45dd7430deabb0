"""Message ingest: posted JSON bodies, one per line, in a landing folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import json_objects as J


def _body_fields() -> list[J.Field]:
    return [J.Field("content", "content", "string", F.lit(""))]


def parse_body(value: Column) -> Column:
    """(ok, body). Names match in any case, further members are ignored."""
    fields = _body_fields()
    parsed = F.from_json(
        value, J.schema_ddl(fields) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    return J.bind(
        parsed,
        lambda p: F.when(
            p["_bad"].isNull() & J.all_present(p, fields),
            J.outcome(F.lit(True), J.strict_struct(p, fields)),
        ).otherwise(
            J.bind(
                F.try_parse_json(value),
                lambda v: F.when(J.is_object(v), J.lenient_object(v, fields, quoted_numbers=True))
                .otherwise(J.outcome(F.lit(False), F.lit(None))),
            )
        ),
    )


def bodies(spark: SparkSession, path: str, stream: bool = True, **options: str) -> DataFrame:
    """`value`, `content` and `malformed`; a null content is malformed, as it must be set."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").options(**options).load(path)
    return lines.select("value", F.explode(F.array(parse_body(F.col("value")))).alias("_parsed")).select(
        "value",
        F.col("_parsed.value.content").alias("content"),
        F.col("_parsed.value.content").isNull().alias("malformed"),
    )


def accepted(read: DataFrame) -> DataFrame:
    return read.where(~F.col("malformed")).select("content")
