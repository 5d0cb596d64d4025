"""Upserts and insert-once appends on control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows overridden by the newest change of their key (``order`` decides inside changes)."""
    columns = current.columns
    others = [c for c in columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    newest = newest.select(*keys, "_row.*").select(*columns)
    return current.join(newest.select(*keys), keys, "left_anti").select(*columns).unionByName(newest)


def append_once(current: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Current rows plus the new ones whose key is not there yet; repeats change nothing."""
    columns = current.columns
    others = [c for c in columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    first = first.select(*key, "_row.*").select(*columns)
    return current.unionByName(first.join(current.select(*key), key, "left_anti").select(*columns))
