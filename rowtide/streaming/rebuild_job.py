"""The rebuild job: stage the re-read table, publish it, replay what was held back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from rowtide.operators import envelope, fold, rebuild
from rowtide.operators.partitions import place_of
from rowtide.session import materialize, scratch_scope
from rowtide.sources.catalog import TableSpec
from rowtide.sources.store import TABLES, Batch, ChangeStore, ConflictError

WRITER = "rebuild"
# Publishing is done again this often when a batch was applied while it ran; the staged table is kept.
CONFLICT_ATTEMPTS = 20


def run_rebuild(
    store: ChangeStore, task_id: str, spec: TableSpec, table: DataFrame, page_size: int = 500, max_retries: int = 3
) -> str:
    """Run one PENDING rebuild task and return its status afterwards.

    The table is re-read into staging. If a newer schema change has arrived meanwhile the task ends OBSOLETE
    and nothing is published. Otherwise staged rows replace the table, pending transactions that nothing blocks
    any more are replayed on top, and the table is ACTIVE again, all in one commit: a driver lost before it
    leaves the task PENDING. A failure counts as a retry, the last one leaves REBUILD_FAILED. Of two drivers
    running one task the first to commit counts.
    """
    task = _task(store, task_id)
    if task is None:
        raise ValueError(f"unknown rebuild task: {task_id}")
    if (task.database_name, task.table_name) != (spec.database, spec.table):
        raise ValueError(f"task {task_id} does not belong to {spec.name}")
    if task.status != "PENDING":
        return task.status
    with scratch_scope(store.spark):
        staged, error = None, None
        if _is_current(store, task):
            try:
                at = {"task_id": task.task_id, "file": task.file, "next_position": task.next_position}
                staged = materialize(rebuild.staged_rows(table, spec, at, page_size), "staging")
            except Exception as failure:  # noqa: BLE001 - every failure of the run is a failed attempt
                error = _first_line(failure)
        for left in reversed(range(CONFLICT_ATTEMPTS)):
            batch = store.begin(WRITER, f"{task_id}#{task.retry_count}")
            if batch is None:
                return _task(store, task_id).status
            try:
                return _finish(store, batch, task, staged, error, max_retries)
            except ConflictError:
                store.discard(batch)
                if not left:
                    raise
    raise AssertionError("unreachable")


def _task(store: ChangeStore, task_id: str) -> Row | None:
    return store.tasks().filter(F.col("task_id") == task_id).first()


def _first_line(failure: Exception) -> str:
    lines = str(failure).splitlines()
    return lines[0] if lines else type(failure).__name__


def _is_current(store: ChangeStore, task: Row) -> bool:
    """Whether the task's coordinate is still the one its table waits for."""
    ours = (F.col("database_name") == task.database_name) & (F.col("table_name") == task.table_name)
    state = store.schema_states().filter(ours).first()
    return state is not None and (state.file, state.next_position) == (task.file, task.next_position)


def _finish(
    store: ChangeStore, batch: Batch, task: Row, staged: DataFrame | None, error: str | None, max_retries: int
) -> str:
    """Publish what was staged, or record why not; returns the task's status."""
    table = store.spark.createDataFrame([(task.database_name, task.table_name)], "database_name string, table_name string")
    status, view = "OBSOLETE", None
    if _is_current(store, task):
        if error is None:
            try:
                view = _published(store, batch, task, staged, table)
            except Exception as failure:  # noqa: BLE001
                store.discard(batch)
                error = _first_line(failure)
        status = "DONE" if error is None else "FAILED" if task.retry_count + 1 >= max_retries else "PENDING"
        _log_status(store, batch, task, {"DONE": "ACTIVE", "FAILED": "REBUILD_FAILED"}.get(status, "REBUILD_REQUIRED"))
        _write_outcomes(store, batch, task, error)
    retries = task.retry_count + (1 if status in ("FAILED", "PENDING") else 0)
    _write_task(store, batch, task, status, retries, error or task.last_error)
    store.commit(batch, view, None if view is None else table)
    return status


def _published(store: ChangeStore, batch: Batch, task: Row, staged: DataFrame, table: DataFrame) -> DataFrame:
    """The rows that replace the table, with the replayed changes of this and other tables on top."""
    one = store.spark.createDataFrame([task], store.tasks().schema)
    candidates = rebuild.replay_candidates(store.pending(), one, exact=False)
    chosen = materialize(rebuild.replayable(candidates, store.schema_states(), table), "replay")
    # Log order stands in for the arrival order the messages had.
    messages = chosen.select(
        "fragment",
        F.col("transaction_id").alias("key"),
        F.col("payload").alias("value"),
        place_of(F.col("file_seq"), F.col("next_position")).alias("arrival"),
    )
    good, poison = envelope.decode_envelopes(messages)
    unreadable = poison.select("key", "reason").limit(1).collect()
    if unreadable:
        raise ValueError(f"held-back message {unreadable[0].key} cannot be parsed: {unreadable[0].reason}")
    _, transactions, _ = envelope.split_messages(good)
    low, high = transactions.agg(F.min("file_seq"), F.max("file_seq")).first()
    done = store.done((low, high) if low is not None else (0, -1))
    fresh, _ = fold.drop_done(fold.dedupe_transactions(transactions), done)
    rows = envelope.explode_rows(fresh)
    if store.mode == "meta":
        merged = fold.merge_view(staged, fold.fold_latest(rows))
    else:
        merged = fold.override_rows(staged, fold.fold_arrival(rows))
    store.write("done", batch, fresh.select("transaction_id", "file_seq").distinct())
    store.write("replayed", batch, chosen.select("transaction_id").distinct())
    return materialize(merged, "published")


def _log_status(store: ChangeStore, batch: Batch, task: Row, status: str) -> None:
    row = (task.database_name, task.table_name, task.file_seq, task.next_position, status)
    store.write("status_log", batch, store.spark.createDataFrame([row], TABLES["status_log"]))


def _write_task(store: ChangeStore, batch: Batch, task: Row, status: str, retries: int, error: str | None) -> None:
    row = {**task.asDict(), "status": status, "retry_count": retries, "last_error": error}
    schema = store.tasks().schema
    changed = store.spark.createDataFrame([tuple(row[c] for c in schema.names)], schema)
    store.write("tasks", batch, changed.withColumn("updated_at", F.current_timestamp()))


def _write_outcomes(store: ChangeStore, batch: Batch, task: Row, error: str | None) -> None:
    rows = [
        (None, seq, "REBUILD", task.database_name, task.table_name, task.task_id, result, message, None)
        for seq, result, message in (
            (1, "STARTED", "rebuild started"),
            (2, "FAILED" if error else "SUCCESS", error or "rebuild completed"),
        )
    ]
    store.write("outcomes", batch, store.spark.createDataFrame(rows, TABLES["outcomes"]).withColumn("ts", F.current_timestamp()))
