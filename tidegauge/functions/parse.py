"""Reading raw payloads and model replies tolerantly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, VariantType

EMPTY = "{}"
#: Fixed value: the number a reply may start with.
LEADING_NUMBER = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp; anything else is null."""
    return F.try_to_timestamp(text)


def latency(reported: Column, start: Column, end: Column) -> Column:
    """Reported milliseconds, else from start to end, else null."""
    return F.coalesce(reported.cast("int"), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("int"))


def money(value: Column) -> Column:
    """A number as DECIMAL(14,6), else null."""
    return value.try_cast("decimal(14,6)")


def field(payload: Column, *path: str, type: str = "string") -> Column:
    """A field deep in a VARIANT, as ``type``; missing, null and what can't be cast are all absent."""
    return F.try_variant_get(payload, "$" + "".join(f".{p}" if re.fullmatch(r"[A-Za-z_]\w*", p) else f"['{p}']" for p in path), type)


def kind(payload: Column, *path: str) -> Column:
    """Type of a field as it was written, such as BIGINT or STRING; null if absent."""
    return F.schema_of_variant(field(payload, *path, type="variant"))


def whole(payload: Column, *path: str) -> Column:
    """An integer that was written as one, else null."""
    return F.when(kind(payload, *path) == "BIGINT", field(payload, *path, type="int"))


def number(payload: Column, *path: str) -> Column:
    """A number that was written as one, else null."""
    return F.when(kind(payload, *path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), field(payload, *path, type="double"))


def is_variant(rows: DataFrame, column: str = "payload") -> bool:
    """Whether a column is a VARIANT."""
    return isinstance(rows.schema[column].dataType, VariantType)


def as_variant(rows: DataFrame, column: str = "payload") -> DataFrame:
    """``rows`` with the column as VARIANT; text is parsed, what is no JSON is null.  Without the column nothing changes."""
    if column not in rows.columns or is_variant(rows, column):
        return rows
    return rows.withColumn(column, F.try_parse_json(column))


def like(rows: DataFrame, schema) -> DataFrame:
    """``rows`` with payloads of the type that ``schema`` has them in, text or VARIANT."""
    for f in schema.fields:
        if f.name in rows.columns and isinstance(f.dataType, VariantType):
            rows = as_variant(rows, f.name)
        elif f.name in rows.columns and isinstance(f.dataType, StringType) and is_variant(rows, f.name):
            rows = rows.withColumn(f.name, F.col(f.name).cast("string"))
    return rows


def nested(payload: Column, *path: str) -> Column:
    """A field deep in a payload that is JSON text; missing and null are both absent."""
    return F.get_json_object(payload, "$" + "".join(f".{p}" for p in path))


def has_payload(payload: Column) -> Column:
    """Whether a run still carries its payload, VARIANT or text."""
    return payload.isNotNull() & (F.regexp_replace(payload.cast("string"), r"\s", "") != EMPTY)


def judge_score(reply: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The number a model's reply starts with, if it lies in range."""
    number = F.regexp_extract(F.trim(reply), LEADING_NUMBER, 1).try_cast("double")
    return F.when(number.between(low, high), number)


def judge_prompt(instruction: str, text: Column) -> Column:
    """Prompt for one text; null where there is nothing to judge."""
    return F.when(text.isNotNull(), F.concat(F.lit(instruction), F.lit("\n\n"), text))
