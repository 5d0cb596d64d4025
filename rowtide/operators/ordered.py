"""Ordered carry over a log without a single-task window.

A log is cut into blocks of consecutive entries. Windows run inside blocks, one short summary
row per block is combined across blocks, and the result is joined back. No task ever holds more
than one block of entries, however large a connector, a file or a transaction is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.versions import file_seq

BLOCK = ["block_file", "block_chunk"]
LOG_ORDER = ["file_seq", "pos", "seq"]
MAX_BLOCKS = 1_000_000


class Blocks(NamedTuple):
    """Block size of a log: ``files`` whole files, or ``span`` log bytes when ``files`` is 1.

    A log entry takes at least 19 bytes, so the default span bounds a block at 3.5M entries.
    """

    files: int = 1
    span: int = 64 << 20


def fit_blocks(log: DataFrame, max_blocks: int = MAX_BLOCKS) -> Blocks:
    """Blocks that take several files together where a log has more than ``max_blocks`` small ones.

    Files are counted, whatever their numbers. A log with a file as long as a block keeps the cut inside files, so
    no block is ever longer than ``span``.
    """
    one = Blocks()
    length = F.max("pos") if "pos" in log.columns else F.lit(0)
    n_files, longest = log.agg(F.count_distinct("file"), length).first()
    files = max(1, -(-n_files // max_blocks))
    return one if files > 1 and files * (longest or 0) >= one.span else Blocks(files=files)


def with_blocks(log: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """Add the numeric file order and the block of every log entry."""
    located = log if "file_seq" in log.columns else log.withColumn("file_seq", file_seq("file"))
    if blocks.files > 1:
        chunk = F.lit(0).cast("bigint")
    else:
        chunk = F.expr(f"pos DIV {int(blocks.span)}")
    return located.withColumns(
        {"block_file": F.expr(f"file_seq DIV {int(blocks.files)}"), "block_chunk": chunk}
    )


def arrival_blocks(rows: DataFrame, arrival: str, size: int = 1_000_000) -> DataFrame:
    """Blocks of ``size`` consecutive arrival numbers."""
    return rows.withColumns(
        {"block_file": F.lit(0).cast("bigint"), "block_chunk": F.expr(f"{arrival} DIV {int(size)}")}
    )


def carry_last(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` at or before each row, per ``keys`` in ``order``."""
    rows = rows.withColumn("_value", value)
    inside = Window.partitionBy(*keys, *BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys, *BLOCK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end")
    )
    earlier = Window.partitionBy(*keys).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *BLOCK, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return (
        local.join(carried, [*keys, *BLOCK], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried")
    )


def commit_scan(log: DataFrame, is_commit: Column, header: Column, n_rows: Column) -> DataFrame:
    """Attach every log entry to the commit that closes it.

    Adds ``commit_group`` (commits strictly before the entry), ``first_index`` (rows of the same
    transaction before the entry) and ``commit`` (``header`` of the closing commit, null while the
    transaction is open).
    """
    log = log.withColumns({"_commit": is_commit, "_header": F.when(is_commit, header), "_n": n_rows})
    scanned = _scan_inside_blocks(log)

    # The summary needs only these columns, so its own pass over the log stays narrow.
    narrow = log.select("connector", *BLOCK, *LOG_ORDER, "_commit", "_header", "_n")
    sizes = _forward(narrow).groupBy("connector", *BLOCK).agg(
        F.count_if("_commit").alias("_commits"),
        F.sum("_n").alias("_rows"),
        F.max(F.when(F.col("_commit"), F.col("_n_before") + F.col("_n"))).alias("_rows_at_commit"),
        F.min_by("_header", F.when(F.col("_commit"), F.struct(*LOG_ORDER))).alias("_first_header"),
    )
    per_connector = Window.partitionBy("connector")
    earlier = per_connector.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = per_connector.orderBy(*[F.desc(b) for b in BLOCK]).rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.withColumns(
        {
            "_commits_in": F.coalesce(F.sum("_commits").over(earlier), F.lit(0)),
            "_rows_in": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        }
    )
    carried = totals.select(
        "connector",
        *BLOCK,
        "_commits_in",
        "_rows_in",
        F.coalesce(
            F.last(F.col("_rows_in") + F.col("_rows_at_commit"), ignorenulls=True).over(earlier), F.lit(0)
        ).alias("_base_in"),
        F.last("_first_header", ignorenulls=True).over(later).alias("_header_in"),
    )
    joined = scanned.join(carried, ["connector", *BLOCK], "left")
    return joined.withColumns(
        {
            "commit_group": F.col("_commits_in") + F.col("_commits_before"),
            "first_index": F.when(
                F.col("_base").isNotNull(), F.col("_n_before") - F.col("_base")
            ).otherwise(F.col("_rows_in") + F.col("_n_before") - F.col("_base_in")),
            "commit": F.coalesce("_header_local", "_header_in"),
        }
    ).drop(*[c for c in joined.columns if c.startswith("_")])


def _forward(log: DataFrame) -> DataFrame:
    before = Window.partitionBy("connector", *BLOCK).orderBy(*LOG_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumns(
        {
            "_commits_before": F.coalesce(F.sum(F.col("_commit").cast("bigint")).over(before), F.lit(0)),
            "_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        }
    )


def _scan_inside_blocks(log: DataFrame) -> DataFrame:
    inside = Window.partitionBy("connector", *BLOCK)
    before = inside.orderBy(*LOG_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    # Reading backwards with a growing frame keeps the look-ahead linear.
    onwards = inside.orderBy(*[F.desc(c) for c in LOG_ORDER]).rowsBetween(Window.unboundedPreceding, 0)
    rows_at_commit = F.when(F.col("_commit"), F.col("_n_before") + F.col("_n"))
    return _forward(log).withColumns(
        {
            "_base": F.last(rows_at_commit, ignorenulls=True).over(before),
            "_header_local": F.last("_header", ignorenulls=True).over(onwards),
        }
    )
