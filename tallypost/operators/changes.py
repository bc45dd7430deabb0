"""Decoding and filtering of change streams: CDC envelopes and logical replication rows.

Every function here maps rows one by one and works on batch and streaming input alike,
apart from `acknowledged_position`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_objects as J
from ..schemas import CDC_PREFIX, CDC_SCHEMA, MESSAGE_TABLE

# What a CDC row image without a time carries.
_NO_TIME = "0001-01-01 00:00:00"


def _after_fields() -> list[J.Field]:
    return [
        J.Field("id", "id", "int", F.lit(0)),
        J.Field("content", "content", "string", F.lit("")),
        J.Field("created_at", "created_at", "timestamp", F.lit(_NO_TIME)),
    ]


def drop_tombstones(log: DataFrame, value: str = "value") -> DataFrame:
    return log.where(F.col(value).isNotNull())


def skip_snapshot(log: DataFrame, value: str = "value") -> DataFrame:
    """Drop rows that a snapshot read put in the log; tombstones pass."""
    op = F.get_json_object(value, "$.op")
    return log.where(op.isNull() | (op != "r"))


def parse_envelope(value: Column) -> Column:
    """(ok, after-image) of an envelope. Whatever the operation, only `after` counts.

    Names match in any case; a quoted number is a fault here.
    """
    fields = _after_fields()
    parsed = F.from_json(
        value,
        f"after struct<{J.schema_ddl(fields).replace('` ', '`:')}>, _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )

    def from_after(hit: Column) -> Column:
        after = hit["value"]
        return (
            F.when(~hit["found"] | J.is_null_literal(after), J.outcome(F.lit(True), F.lit(None)))
            .when(J.is_object(after), J.lenient_object(after, fields, quoted_numbers=False))
            .otherwise(J.outcome(F.lit(False), F.lit(None)))
        )

    def choose(p: Column) -> Column:
        # A delete. The text is read again only if it might hold the name in another case.
        no_image = p["_bad"].isNull() & p["after"].isNull() & J.only_spelled(value, "after") & J.looks_like_object(value)
        clean = p["_bad"].isNull() & J.all_present(p["after"], fields)
        again = J.bind(
            F.try_parse_json(value),
            lambda v: F.when(J.is_null_literal(v), J.outcome(F.lit(True), F.lit(None)))
            .when(J.is_object(v), J.bind(J.member(v, "after"), from_after))
            .otherwise(J.outcome(F.lit(False), F.lit(None))),
        )
        return (
            F.when(value.isNull(), J.outcome(F.lit(True), F.lit(None)))
            .when(clean, J.outcome(F.lit(True), J.strict_struct(p["after"], fields)))
            .when(no_image, J.outcome(F.lit(True), F.lit(None)))
            .otherwise(again)
        )

    return J.bind(parsed, choose)


def decode_envelopes(log: DataFrame, value: str = "value") -> DataFrame:
    """Add `after` and `malformed`; one parse per row."""
    return log.select(
        "*", F.explode(F.array(parse_envelope(F.col(value).cast("string")))).alias("_parsed")
    ).select(*log.columns, F.col("_parsed.value").alias("after"), (~F.col("_parsed.ok")).alias("malformed"))


def after_images(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Row images of decoded envelopes; deletes and broken values have none."""
    rest = [c for c in decoded.columns if c not in (value, "after", "malformed")]
    return decoded.where(F.col("after").isNotNull()).select(*rest, "after.*")


def cdc_after_image(log: DataFrame, value: str = "value") -> DataFrame:
    return after_images(decode_envelopes(log, value), value)


def insert_only(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("kind") == "insert")


def table_filter(changes: DataFrame, relation: str = MESSAGE_TABLE) -> DataFrame:
    return changes.where(F.col("relation") == relation)


def project_by_name(rows: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, content, created_at by name in any order; a missing column takes its default."""
    defaults = {
        "id": F.lit(0),
        "content": F.lit(""),
        "created_at": F.current_timestamp() if now is None else now,
    }
    return rows.select(
        *keep,
        *[F.col(c) if c in rows.columns else default.alias(c) for c, default in defaults.items()],
    )


def topic_route(changes: DataFrame) -> DataFrame:
    """The topic a change goes to: prefix.schema.table."""
    return changes.withColumn(
        "topic", F.concat_ws(".", F.lit(CDC_PREFIX), F.lit(CDC_SCHEMA), F.col("relation"))
    )


def acknowledged_position(changes: DataFrame) -> DataFrame:
    """Highest position read, over changes of every kind, next to that of inserts alone."""
    return changes.agg(
        F.max("wal_end").alias("acknowledged"),
        F.max(F.when(F.col("kind") == "insert", F.col("wal_end"))).alias("last_insert"),
    )
