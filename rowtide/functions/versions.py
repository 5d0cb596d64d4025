"""Row versions and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowtide import schemas as S
from rowtide.functions.values import java_trim


def file_seq(file: str | Column) -> Column:
    """Number at the end of a log file name, -1 when there is none."""
    # No digits give an empty text, which casts to null. A ``nullif`` would be a step of its own below which a scan
    # reads all of the struct that holds the name.
    digits = F.regexp_extract(_col(file), r"(\d+)$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def row_version(seq: str | Column, next_position: str | Column, event_index: str | Column) -> Column:
    """Orderable version of a row change; compare with ``>`` or aggregate with ``max``."""
    return F.struct(
        _col(seq).cast("bigint").alias("file_seq"),
        _col(next_position).cast("bigint").alias("next_position"),
        _col(event_index).cast("bigint").alias("event_index"),
    )


def is_newer(incoming: Column, stored: Column) -> Column:
    """True when the incoming version may replace the stored one (equal versions may not)."""
    return stored.isNull() | (incoming > stored)


def normalize_op(op: str | Column) -> Column:
    """SNAPSHOT_UPSERT acts as an UPDATE; other operations keep their name."""
    op = _col(op)
    return F.when(op == "SNAPSHOT_UPSERT", F.lit("UPDATE")).otherwise(op)


def view_action(op: str | Column) -> Column:
    """SET for writes, DEL for deletes, null for an unknown operation."""
    op = _col(op)
    return F.when(op.isin(*S.WRITE_OPS), F.lit("SET")).when(op == S.DELETE_OP, F.lit("DEL"))


def key_text(primary_key: str | Column) -> Column:
    """Key values joined by ':' in key order; a null value prints as ``null``."""
    values = F.map_values(_col(primary_key))
    return F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("null"))), ":")


def table_scope(database: str | Column, table: str | Column, scope: str = "DATABASE_TABLE") -> Column:
    """Table qualifier of a key; a blank name is an error."""
    database, table = _col(database), _col(table)
    blank_table = F.coalesce(java_trim(table), F.lit("")) == ""
    blank_database = F.coalesce(java_trim(database), F.lit("")) == ""
    failure = F.raise_error(F.lit("row change without database/table identity")).cast("string")
    if scope == "TABLE":
        return F.when(blank_table, failure).otherwise(table)
    if scope == "DATABASE_TABLE":
        return F.when(blank_table | blank_database, failure).otherwise(F.concat_ws(".", database, table))
    raise ValueError(f"unknown key scope: {scope}")


def business_key(database, table, row_key, scope: str = "DATABASE_TABLE", prefix: str = S.KEY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), table_scope(database, table, scope), F.lit(":"), _col(row_key))


def meta_key(database, table, row_key, scope: str = "DATABASE_TABLE", prefix: str = S.META_PREFIX) -> Column:
    return business_key(database, table, row_key, scope, prefix)


def done_key(transaction_id: str | Column, prefix: str = S.DONE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), _col(transaction_id))


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
