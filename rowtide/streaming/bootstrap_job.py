"""The snapshot job: pages of every configured table as messages, progress, one checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide import schemas as S
from rowtide.functions.versions import file_seq
from rowtide.operators import envelope, snapshot
from rowtide.operators.snapshot import Cutover, SnapshotTable
from rowtide.session import scratch_scope
from rowtide.sources.store import Batch, ChangeStore

WRITER = "snapshot"


def run_bootstrap(store: ChangeStore, tables: list[SnapshotTable], cutover: Cutover, page_size: int = 500) -> None:
    """Publish a snapshot of the tables, in configured order, at one cutover position.

    Every table is its own committed version with its progress row, so progress can be watched. The
    checkpoint is written after the last one. When a table fails it is marked FAILED, nothing after
    it is read and no checkpoint is saved; a later run starts from scratch and its repeated pages
    carry the same transaction ids.
    """
    if not tables:
        raise ValueError("at least one configured table is required for a snapshot")
    run = f"{cutover.connector}:{cutover.file}:{cutover.position}@{store.latest()}"
    batch = store.begin(WRITER, f"{run}:start")
    started = store.spark.createDataFrame(
        [(cutover.connector, t.spec.database, t.spec.table, "RUNNING", cutover.file, cutover.position) for t in tables],
        "connector string, database_name string, table_name string, status string, cutover_file string, cutover_position bigint",
    ).withColumns(
        {"last_sent_pk": F.lit(None).cast("string"), "started_at": F.current_timestamp(),
         "finished_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")}
    )
    store.write("full_sync", batch, started)
    store.commit(batch)
    for order, table in enumerate(tables):
        batch = store.begin(WRITER, f"{run}:{order}")
        try:
            with scratch_scope(store.spark):
                _publish_table(store, batch, table, cutover, page_size)
        except Exception as failure:
            store.discard(batch)
            _write_progress(store, batch, table, cutover, "FAILED", None, _failure_text(failure))
            store.commit(batch)
            raise
        store.commit(batch)
    batch = store.begin(WRITER, f"{run}:checkpoint")
    row = store.spark.createDataFrame(
        [(cutover.connector, cutover.file, cutover.position)], "connector string, file string, position bigint"
    )
    store.write("checkpoints", batch, row.withColumn("file_seq", file_seq("file")))
    store.commit(batch)


def _publish_table(
    store: ChangeStore, batch: Batch, table: SnapshotTable, cutover: Cutover, page_size: int
) -> None:
    spec, pk = table.spec, list(table.spec.primary_key)
    paged = snapshot.paginate(table.df.select(*spec.columns), pk, page_size)
    transactions = snapshot.snapshot_transactions(paged, spec, cutover, page_size)
    messages = envelope.encode_transactions(transactions, keep=("xid",)).select(
        F.lit("changes").alias("topic"), F.lit(0).alias("partition"), (F.col("xid") + store.first_arrival(batch)).alias("arrival"),
        "key", "fragment", "value",
    )
    store.write("messages", batch, messages)
    pages = snapshot.pages(paged, pk)
    last = pages.agg(F.max_by("last_pk", "page_index")).first()[0]
    _write_progress(store, batch, table, cutover, "COMPLETED", last, None)
    listed = pages.select(
        F.current_timestamp().alias("ts"),
        F.col("page_index").alias("seq"),
        F.lit("SNAPSHOT_ROW").alias("event_type"),
        F.lit(spec.database).alias("database_name"),
        F.lit(spec.table).alias("table_name"),
        snapshot.snapshot_id(spec, cutover).alias("reference"),
        F.lit("PUBLISHED").alias("result"),
        F.concat(F.lit("rows="), F.col("n_rows").cast("string")).alias("message"),
        "n_rows",
    )
    store.write("outcomes", batch, listed)


def _write_progress(
    store: ChangeStore, batch: Batch, table: SnapshotTable, cutover: Cutover, status: str, last_pk: str | None,
    error: str | None,
) -> None:
    key = {"connector": cutover.connector, "database_name": table.spec.database, "table_name": table.spec.table}
    mine = F.lit(True)
    for column, value in key.items():
        mine = mine & (F.col(column) == value)
    current: DataFrame = store.full_sync_tasks().filter(mine)
    row = current.withColumns(
        {
            "status": F.lit(status),
            "last_sent_pk": F.lit(last_pk).cast("string"),
            "finished_at": F.current_timestamp(),
            "last_error": F.lit(error).cast("string"),
        }
    )
    store.write("full_sync", batch, row)


def _failure_text(failure: Exception) -> str:
    """What failed and why, in one line."""
    lines = str(failure).splitlines()
    cause = lines[0] if lines else type(failure).__name__
    return f"{S.PUBLISH_PAGE_ERROR}: {cause}"

