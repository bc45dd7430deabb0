"""Topic records: encode messages to key and value bytes, decode them again."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import json_objects as J
from .names import camel

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def key_bytes(id_: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(id_.cast("long")), 16, "0"), F.lit(8)))


def key_int(key: Column) -> Column:
    """Signed int of four big-endian bytes; null for any other length."""
    unsigned = F.conv(F.hex(key), 16, 10).cast("long")
    signed = F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)
    return F.when(F.octet_length(key) == 4, signed.cast("int"))


def message_json(id_: Column, content: Column, created_at: Column) -> Column:
    return F.to_json(
        F.struct(
            id_.alias("id"),
            content.alias("content"),
            created_at.cast("timestamp").alias(camel("created_at")),
        ),
        {"timestampFormat": JSON_TIME, "ignoreNullFields": "false"},
    )


def message_fields(now: Column | None = None) -> list[J.Field]:
    """Members of a message document; what is missing takes the default."""
    return [
        J.Field("id", "id", "int", F.lit(0)),
        J.Field("content", "content", "string", F.lit("")),
        J.Field("createdAt", "created_at", "timestamp", F.current_timestamp() if now is None else now),
    ]


def parse_message(value: Column, now: Column | None = None) -> Column:
    """(ok, message) of a JSON value. A null value is a null message, not a fault."""
    fields = message_fields(now)
    parsed = F.from_json(
        value, J.schema_ddl(fields) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )

    def choose(p: Column) -> Column:
        clean = p["_bad"].isNull() & J.all_present(p, fields)
        again = J.bind(
            F.try_parse_json(value),
            lambda v: F.when(J.is_null_literal(v), J.outcome(F.lit(True), F.lit(None)))
            .when(J.is_object(v), J.lenient_object(v, fields, quoted_numbers=True))
            .otherwise(J.outcome(F.lit(False), F.lit(None))),
        )
        return (
            F.when(value.isNull(), J.outcome(F.lit(True), F.lit(None)))
            .when(clean, J.outcome(F.lit(True), J.strict_struct(p, fields)))
            .otherwise(again)
        )

    return J.bind(parsed, choose)


@dataclass(frozen=True)
class Serializer:
    """The pair of column functions a topic is written and read with."""

    encode: Callable[[Column, Column, Column], Column]
    decode: Callable[[Column], Column]


JSON_SERIALIZER = Serializer(
    encode=lambda id_, content, created_at: message_json(id_, content, created_at).cast("binary"),
    decode=lambda value: parse_message(value.cast("string")),
)


def encode_records(messages: DataFrame, serializer: Serializer = JSON_SERIALIZER) -> DataFrame:
    """Messages as (key, value, timestamp) records."""
    return messages.select(
        key_bytes(F.col("id")).alias("key"),
        serializer.encode(F.col("id"), F.col("content"), F.col("created_at")).alias("value"),
        F.col("created_at").cast("timestamp").alias("timestamp"),
    )


def decode_records(records: DataFrame, serializer: Serializer = JSON_SERIALIZER) -> DataFrame:
    """Add `id`, `message` and `malformed` to records.

    The parse runs in a generator, which Catalyst does not copy into later filters.
    """
    return records.select(
        key_int(F.col("key")).alias("id"),
        "*",
        F.explode(F.array(serializer.decode(F.col("value")))).alias("_parsed"),
    ).select(
        "id",
        *records.columns,
        F.col("_parsed.value").alias("message"),
        (F.col("id").isNull() | ~F.col("_parsed.ok")).alias("malformed"),
    )


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records without their raw form, and the quarantine in nothing but it."""
    return (
        decoded.where(~F.col("malformed")).drop("malformed", "key", "value"),
        decoded.where("malformed").drop("malformed", "id", "message", "after", "content"),
    )
