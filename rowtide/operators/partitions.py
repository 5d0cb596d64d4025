"""Messages of several partitions in the order of the log they came from.

Offsets of two partitions say nothing about each other, but every message names its place in the log, and each partition
holds its messages in log order. So whatever lies at or before the place that every partition has reached is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.versions import file_seq

# A position inside a file takes the low bits of a place.
POSITION_BITS = 36


def place_of(file_number: Column, position: Column) -> Column:
    """Log coordinate as one number that orders as the coordinate does."""
    return F.shiftleft(file_number, POSITION_BITS) + position


def with_place(parsed: DataFrame) -> DataFrame:
    """Parsed messages with their ``place`` in the log, null where a message names none."""
    at = {
        source: place_of(file_seq(F.col(f"{source}.binlogFilename")), F.col(f"{source}.nextPosition"))
        for source in ("transaction", "schema_change")
    }
    return parsed.withColumn("place", F.coalesce(at["transaction"], at["schema_change"]))


def frontiers(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """Farthest place seen of each partition, in this batch or before: one row a partition."""
    seen = placed.filter("partition IS NOT NULL AND place IS NOT NULL").select("partition", "place")
    return seen.unionByName(stored.select("partition", "place")).groupBy("partition").agg(F.max("place").alias("place"))


def reached(frontier: DataFrame, partitions: list[int]) -> int:
    """The place every one of ``partitions`` has reached; -1 while one of them has shown nothing."""
    seen = {row.partition: row.place for row in frontier.filter(F.col("partition").isin(partitions)).collect()}
    return min(seen.get(p, -1) for p in partitions)


def split_ahead(placed: DataFrame, low: int | None) -> tuple[DataFrame, DataFrame]:
    """Messages up to a place, and those ahead of it. Messages without a place wait for nothing; no place: all are ready."""
    if low is None:
        return placed, placed.filter("false")
    ahead = F.coalesce(F.col("place") > low, F.lit(False))
    return placed.filter(~ahead), placed.filter(ahead)


def in_log_order(rows: DataFrame) -> DataFrame:
    """Transactions or schema changes with their place as arrival number."""
    return rows.withColumn("arrival", F.coalesce(place_of(F.col("file_seq"), F.col("next_position")), F.col("arrival")))
