"""Keyset pages, full paging and snapshot transactions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.values import exported, java_trim, row_json
from rowtide.functions.versions import file_seq
from rowtide.operators.assemble import assemble_transactions
from rowtide.session import materialize
from rowtide.sources.catalog import TableSpec

# monotonically_increasing_id keeps the row number inside its partition in the low 33 bits.
_ROW_BITS = 33


@dataclass(frozen=True)
class Cutover:
    """The log position a snapshot belongs to."""

    connector: str
    file: str
    position: int


def after_cursor(pk: list[str], cursor: dict) -> Column:
    """Rows whose key tuple is greater than the cursor, as comparisons a scan can use."""
    missing = [c for c in pk if c not in cursor]
    if missing:
        raise ValueError(f"missing cursor value for primary key: {missing[0]}")
    steps = []
    for i, column in enumerate(pk):
        equal = [F.col(c) == F.lit(cursor[c]) for c in pk[:i]]
        steps.append(reduce(Column.__and__, [*equal, F.col(column) > F.lit(cursor[column])]))
    return reduce(Column.__or__, steps)


def keyset_page(df: DataFrame, pk: list[str], cursor: dict | None, n: int) -> DataFrame:
    """Next ``n`` rows after ``cursor`` in key order."""
    if n <= 0:
        raise ValueError("page size must be greater than 0")
    rows = df.filter(after_cursor(pk, cursor)) if cursor else df
    return rows.orderBy(*pk).limit(n)


def with_rank(df: DataFrame, pk: list[str], partitions: int | None = None) -> DataFrame:
    """Add the 0-based ``row_rank`` in key order and ``n_total``.

    Rows are range-partitioned and sorted by key, numbered inside their partition, and written to
    the shared folder so that both uses below see one and the same partitioning. A rank is the
    start of the partition plus the number inside it; the only global step is over one row per
    partition.
    """
    ranged = df.repartitionByRange(partitions, *pk) if partitions else df.repartitionByRange(*pk)
    placed = ranged.sortWithinPartitions(*pk).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    inside = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
    whole = Window.partitionBy()
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("n_total"),
    )
    # One row per partition of the write: as small as the number of its tasks.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("row_rank", F.col("_start") + inside)
        .drop("_at", "_part", "_start")
    )


def paginate(df: DataFrame, pk: list[str], n: int, partitions: int | None = None) -> DataFrame:
    """Every row with its ``page_index``, ``row_index``, and whether its page is full and it ends it."""
    if n <= 0:
        raise ValueError("page size must be greater than 0")
    ranked = with_rank(df, pk, partitions)
    page = F.floor(F.col("row_rank") / n)
    ends = (F.col("row_index") == n - 1) | (F.col("row_rank") == F.col("n_total") - 1)
    return (
        ranked.withColumns({"page_index": page.cast("bigint"), "row_index": F.col("row_rank") % n})
        .withColumns({"has_more": (F.col("page_index") + 1) * n <= F.col("n_total"), "last_in_page": ends})
        .drop("n_total")
    )


def pages(paged: DataFrame, pk: list[str]) -> DataFrame:
    """One row per page: size, last key as JSON, has_more. Needs no shuffle."""
    return paged.filter("last_in_page").select(
        "page_index",
        (F.col("row_index") + 1).alias("n_rows"),
        row_json(paged, pk).alias("last_pk"),
        "has_more",
    )


def snapshot_id(spec: TableSpec, cutover: Cutover) -> Column:
    prefix = f"snapshot:{cutover.connector}:{spec.name}:{cutover.file}:{cutover.position}:"
    return F.concat(F.lit(prefix), F.col("page_index").cast("string"))


def snapshot_rows(paged: DataFrame, spec: TableSpec, cutover: Cutover, now_ms: Column | None = None) -> DataFrame:
    """Pages as row changes: SNAPSHOT_UPSERT at the cutover version, index inside the page."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    pk_values = F.array(*[exported(c, paged.schema[c].dataType).cast("string") for c in spec.primary_key])
    return paged.select(
        F.lit(cutover.connector).alias("connector"),
        F.lit(cutover.file).alias("file"),
        file_seq(F.lit(cutover.file)).alias("file_seq"),
        F.col("page_index").alias("xid"),
        F.lit(cutover.position).cast("bigint").alias("next_position"),
        now.alias("ts_ms"),
        snapshot_id(spec, cutover).alias("transaction_id"),
        F.col("row_index").alias("event_index"),
        F.lit(spec.database).alias("database_name"),
        F.lit(spec.table).alias("table_name"),
        F.lit("SNAPSHOT_UPSERT").alias("op"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in spec.primary_key]), pk_values).alias("primary_key"),
        F.lit(None).cast("string").alias("before"),
        row_json(paged, list(spec.columns)).alias("after"),
        row_json(paged, list(spec.primary_key)).alias("primary_key_json"),
        F.array_join(
            F.transform(pk_values, lambda v: F.coalesce(v, F.lit("null"))), ":"
        ).alias("row_key"),
    )


def snapshot_transactions(paged: DataFrame, spec: TableSpec, cutover: Cutover, page_size: int) -> DataFrame:
    """One SNAPSHOT_UPSERT transaction per page, its rows as an ordered array of page size."""
    return assemble_transactions(snapshot_rows(paged, spec, cutover), max_events=page_size)


@dataclass
class SnapshotTable:
    spec: TableSpec
    df: DataFrame


def bootstrap(tables: list[SnapshotTable], cutover: Cutover, page_size: int = 500) -> tuple[DataFrame, DataFrame]:
    """Snapshot of every table at one cutover: row changes, and page summaries per table.

    Tables keep their configured order in ``table_order``; Spark is free to run them together.
    """
    if not tables:
        raise ValueError("at least one configured table is required for a snapshot")
    changes, summaries = [], []
    for order, table in enumerate(tables):
        paged = paginate(table.df.select(*table.spec.columns), list(table.spec.primary_key), page_size)
        tag = F.lit(order).alias("table_order")
        changes.append(snapshot_rows(paged, table.spec, cutover).select("*", tag))
        summaries.append(
            pages(paged, list(table.spec.primary_key)).select(
                F.lit(table.spec.database).alias("database_name"),
                F.lit(table.spec.table).alias("table_name"),
                tag,
                "*",
            )
        )
    return reduce(DataFrame.unionByName, changes), reduce(DataFrame.unionByName, summaries)


def failure_text(message: Column, root_cause: Column) -> Column:
    """``message: root cause``, the message alone when the cause adds nothing."""
    adds = (F.coalesce(java_trim(root_cause), F.lit("")) != "") & ~message.eqNullSafe(root_cause)
    return F.when(adds, F.concat(message, F.lit(": "), root_cause)).otherwise(message)


def full_sync_progress(
    catalog: DataFrame, page_rows: DataFrame, cutover: Cutover, failures: DataFrame | None = None
) -> DataFrame:
    """Progress per table after a bootstrap run.

    ``page_rows`` holds the published pages. ``failures`` has one row (database, table, message,
    root_cause) for the table whose publishing failed: it is FAILED, later tables stay RUNNING.
    """
    sent = page_rows.groupBy("database_name", "table_name").agg(
        F.max_by("last_pk", "page_index").alias("last_sent_pk"),
        F.count("*").alias("n_pages"),
        F.sum("n_rows").alias("n_rows"),
    )
    tables = catalog.select("database_name", "table_name", "table_order")
    rows = tables.join(sent, ["database_name", "table_name"], "left")
    if failures is None:
        rows = rows.withColumns({"last_error": F.lit(None).cast("string"), "_failed_at": F.lit(None).cast("int")})
    else:
        failed = failures.select(
            "database_name", "table_name", failure_text(F.col("message"), F.col("root_cause")).alias("last_error")
        )
        first = tables.join(failed, ["database_name", "table_name"]).agg(F.min("table_order"))
        rows = rows.join(failed, ["database_name", "table_name"], "left").withColumn("_failed_at", first.scalar())
    order, failed_at = F.col("table_order"), F.col("_failed_at")
    status = (
        F.when(failed_at.isNull() | (order < failed_at), F.lit("COMPLETED"))
        .when(order == failed_at, F.lit("FAILED"))
        .otherwise(F.lit("RUNNING"))
    )
    return rows.select(
        F.lit(cutover.connector).alias("connector"),
        "database_name",
        "table_name",
        "table_order",
        status.alias("status"),
        F.lit(cutover.file).alias("cutover_file"),
        F.lit(cutover.position).cast("bigint").alias("cutover_position"),
        "last_sent_pk",
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "last_error",
    )


def bootstrap_checkpoint(progress: DataFrame) -> DataFrame:
    """The cutover as checkpoint, only when every table completed."""
    return (
        progress.groupBy("connector")
        .agg(
            F.bool_and(F.col("status") == "COMPLETED").alias("_complete"),
            F.max("cutover_file").alias("file"),
            F.max("cutover_position").alias("position"),
        )
        .filter("_complete")
        .select("connector", "file", file_seq("file").alias("file_seq"), "position")
    )
