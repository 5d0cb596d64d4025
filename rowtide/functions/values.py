"""Value normalisation and JSON text helpers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def utc_wall(ts: Column) -> Column:
    """Wall-clock time of an instant in UTC, whatever the session's time zone is."""
    seconds = (F.unix_micros(ts).cast("decimal(18,0)") * F.expr("0.000001BD")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.expr(_EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)


def utc_instant(wall: str) -> Column:
    """Instant of a wall-clock column that holds UTC times."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {wall})"))


def _iso_text(wall: Column, drop_zero_seconds: bool = False) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` with 0, 3 or 6 fraction digits, whichever is the shortest exact form."""
    text = F.replace(wall.cast("string"), F.lit(" "), F.lit("T"))
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    digits = F.when(F.length(fraction) <= 3, F.rpad(fraction, 3, "0")).otherwise(F.rpad(fraction, 6, "0"))
    if drop_zero_seconds:
        whole_only = F.when(F.endswith(whole, F.lit(":00")), F.substring(whole, 1, 16)).otherwise(whole)
    else:
        whole_only = whole
    return F.when(fraction == "", whole_only).otherwise(F.concat(whole, F.lit("."), digits))


def iso_instant(ts: Column) -> Column:
    """UTC instant text."""
    return F.concat(_iso_text(utc_wall(ts)), F.lit("Z"))


def base64_text(value: Column) -> Column:
    """Base64 without line breaks, whatever ``spark.sql.chunkBase64String.enabled`` says."""
    return F.replace(F.base64(value), F.lit("\r\n"), F.lit(""))


def normalized(name: str, dtype: T.DataType) -> Column:
    """One column in the form row images carry it."""
    value = F.col(name)
    if isinstance(dtype, T.BinaryType):
        return base64_text(value)
    if isinstance(dtype, T.TimestampType):
        return iso_instant(value)
    if isinstance(dtype, T.TimestampNTZType):
        return _iso_text(value, drop_zero_seconds=True)
    if isinstance(dtype, (T.DateType, T.TimeType)):
        return value.cast("string")
    return value


def java_trim(value: str | Column) -> Column:
    """Text without the blanks and control characters (up to U+0020) at its ends."""
    value = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(value: Column, around: str = "") -> Column:
    """Whether ``java_trim`` leaves nothing but the plain text ``around``; the text is read up to the first mismatch only."""
    return value.rlike(rf"\A[\x00-\x20]*{around}[\x00-\x20]*\z")


def json_string(value: Column) -> Column:
    """A string as a quoted JSON token; null gives the token ``null``."""
    # A one-element list is the token in brackets, and the token itself never ends in one.
    return F.btrim(F.to_json(F.array(value.cast("string"))), F.lit("[]"))


def json_with(fields: Column, extra: dict[str, Column]) -> Column:
    """A struct of plain values as a JSON object, followed by fields that are JSON text already."""
    # The last plain field must be a number or a quoted string, so one brace closes the object.
    parts = [F.rtrim(F.to_json(fields, {"ignoreNullFields": "false"}), F.lit("}"))]
    for name, value in extra.items():
        parts += [F.lit(f',"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def bare_pattern(columns: list[str]) -> str:
    """Pattern of the quoted values that ``map_json`` prints bare: JSON numbers and truth values.

    Inside a JSON string every quote is escaped, so the pattern can match field names only. Any other
    text of such a column (empty, padded with zeros) stays quoted, so the object is always valid JSON.
    """
    if not columns:
        return "(?!)()()"
    names = "|".join(re.escape(json.dumps(c, ensure_ascii=False)) for c in columns)
    return f"({names}){_BARE_VALUE}"


_BARE_VALUE = r':"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false)"'


def bare_pattern_of(columns: Column) -> Column:
    """``bare_pattern`` of an array of column names."""
    quoted = F.transform(columns, lambda c: F.concat(F.lit("\\Q"), json_string(c), F.lit("\\E")))
    pattern = F.concat(F.lit("("), F.array_join(quoted, "|"), F.lit(f"){_BARE_VALUE}"))
    return F.when(F.size(columns) > 0, pattern).otherwise(F.lit("(?!)()()"))


def map_json(image: Column, bare: Column) -> Column:
    """A map of texts as one JSON object in map order, values matching ``bare`` without quotes."""
    return F.regexp_replace(F.to_json(image, {"ignoreNullFields": "false"}), bare, F.lit("$1:$2"))


def exported(name: str, dtype: T.DataType) -> Column:
    """One column in the form snapshot images carry it.

    As ``normalized``, but a wall-clock time keeps its seconds and only the fraction digits it needs.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T"))
    return normalized(name, dtype)


def row_json(df: DataFrame, columns: list[str]) -> Column:
    """Columns of a table as one JSON object with its nulls kept, fields in the given order.

    The text does not depend on the session's time zone or JSON options.
    """
    fields = [exported(c, df.schema[c].dataType).alias(c) for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
