"""Column naming: snake_case in tables, camelCase in JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.capitalize() for part in tail)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def to_camel(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: camel(c) for c in df.columns})


def to_snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake(c) for c in df.columns})
