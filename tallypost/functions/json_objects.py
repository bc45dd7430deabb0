"""JSON reading that ignores the case of names and keeps broken values apart.

`from_json` reads the usual document in one pass. Only where its result looks
incomplete is the text read again as a variant, whose members can be looked up in
any case and whose value kinds are known.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Field:
    """A member of a JSON object: its name there, our name, Spark type and default."""

    json_name: str
    name: str
    dtype: str
    default: Column


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use the result several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def schema_ddl(fields: list[Field]) -> str:
    return ", ".join(f"`{f.json_name}` {f.dtype}" for f in fields)


def member(obj: Column, name: str) -> Column:
    """Last member called `name` in any case, as (found, value); `obj` is a variant."""
    entries = F.map_entries(obj.try_cast("map<string,variant>"))
    hits = F.filter(entries, lambda e: F.lower(e["key"]) == name.lower())
    return bind(
        hits,
        lambda h: F.struct(
            (F.coalesce(F.size(h), F.lit(0)) > 0).alias("found"),
            F.try_element_at(h, F.lit(-1))["value"].alias("value"),
        ),
    )


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_null_literal(value: Column) -> Column:
    return F.coalesce(kind(value) == "VOID", F.lit(False))


def _typed(hit: Column, field: Field, quoted_numbers: bool) -> Column:
    """(ok, value) of one member, by the rules of the field's type."""
    value, shape = hit["value"], kind(hit["value"])
    if field.dtype == "int":
        text = value.try_cast("string")
        fits = shape == "BIGINT"
        if quoted_numbers:
            fits = fits | ((shape == "STRING") & text.rlike(r"^-?\d+$"))
        read = F.when(fits, text.try_cast("int"))
        good = read.isNotNull()
    elif field.dtype == "string":
        read = F.when(shape == "STRING", value.try_cast("string"))
        good = shape.isin("STRING", "VOID")
    elif field.dtype == "timestamp":
        read = F.when(shape == "STRING", value.try_cast("string").try_cast("timestamp"))
        good = read.isNotNull()
    else:
        raise ValueError(f"no JSON rule for {field.dtype}")
    return F.struct(
        F.when(hit["found"], F.coalesce(good, F.lit(False))).otherwise(F.lit(True)).alias("ok"),
        F.when(hit["found"], read).otherwise(field.default.cast(field.dtype)).alias("value"),
    )


def lenient_object(obj: Column, fields: list[Field], quoted_numbers: bool) -> Column:
    """(ok, value struct) of a variant that should be an object with these fields."""
    def read(field: Field) -> Column:
        return bind(member(obj, field.json_name), lambda hit: _typed(hit, field, quoted_numbers))

    parts = F.struct(*[read(f).alias(f.name) for f in fields])

    def gather(p: Column) -> Column:
        ok = reduce(lambda a, b: a & b, [p[f.name]["ok"] for f in fields])
        value = F.struct(*[p[f.name]["value"].alias(f.name) for f in fields])
        return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"))

    return bind(parts, gather)


def only_spelled(text: Column, name: str) -> Column:
    """The name occurs in no other case than this one, nor hidden by an escape."""
    quoted = F.lit(f'"{name}"')
    nothing = F.lit("")
    same = F.length(F.replace(F.lower(text), quoted, nothing)) == F.length(F.replace(text, quoted, nothing))
    return same & ~text.contains("\\u")


def looks_like_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def outcome(ok: Column, value: Column) -> Column:
    return F.struct(ok.alias("ok"), value.alias("value"))


def strict_struct(parsed: Column, fields: list[Field]) -> Column:
    return F.struct(*[parsed[f.json_name].alias(f.name) for f in fields])


def all_present(parsed: Column, fields: list[Field]) -> Column:
    return reduce(lambda a, b: a & b, [parsed[f.json_name].isNotNull() for f in fields])
