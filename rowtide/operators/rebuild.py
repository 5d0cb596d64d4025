"""Rebuild tasks: choice, staging, replay, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide import schemas as S
from rowtide.operators.snapshot import Cutover, paginate, snapshot_rows
from rowtide.session import lookup_join
from rowtide.sources.catalog import TableSpec

TABLE = ["database_name", "table_name"]
COORDINATE = ["file_seq", "next_position"]
REPLAY_ORDER = ["file_seq", "next_position", "fragment"]


def mark_obsolete(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``current``: the task's coordinate is its table's latest one; unfinished others turn OBSOLETE."""
    latest = states.select(*TABLE, F.struct("file", "next_position").alias("_latest"))
    joined = lookup_join(tasks, latest, TABLE, spread=["task_id"])
    current = F.struct("file", "next_position").eqNullSafe(F.col("_latest"))
    open_task = F.col("status").isin("PENDING", "RUNNING")
    status = F.when(open_task & ~current, F.lit("OBSOLETE")).otherwise(F.col("status"))
    return joined.withColumns({"current": current, "status": status}).drop("_latest")


def runnable_tasks(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """The next task of every table: PENDING and current, newest coordinate, then oldest."""
    ready = mark_obsolete(tasks, states).filter((F.col("status") == "PENDING") & F.col("current"))
    others = [c for c in tasks.columns if c not in TABLE]
    order = F.struct(*COORDINATE, -F.unix_micros("created_at"), "task_id")
    best = ready.groupBy(*TABLE).agg(F.max_by(F.struct(*others), order).alias("_t"))
    return best.select(*TABLE, "_t.*").select(*tasks.columns)


def next_pending(tasks: DataFrame) -> DataFrame:
    """The oldest PENDING task."""
    return tasks.filter(F.col("status") == "PENDING").orderBy("created_at", "task_id").limit(1)


def claim(tasks: DataFrame, task_id: str) -> DataFrame:
    """PENDING to RUNNING for one task; a task in any other status is left alone."""
    hit = (F.col("task_id") == task_id) & (F.col("status") == "PENDING")
    return tasks.withColumn("status", F.when(hit, F.lit("RUNNING")).otherwise(F.col("status")))


def replay_candidates(pending: DataFrame, tasks: DataFrame, exact: bool = True) -> DataFrame:
    """Pending messages each task may replay, with its ``task_id``.

    ``exact`` takes messages blocked at the task's own coordinate. Otherwise every pending message
    that touches the task's table is taken, also one that an earlier, superseded change or another
    table blocked, by the table's newest task; ``replayable`` then holds back what is still blocked.
    """
    if not exact:
        newest = F.max_by("task_id", F.struct(*COORDINATE, "task_id"))
        last = tasks.groupBy(*TABLE).agg(newest.alias("task_id"), F.max(F.struct(*COORDINATE)).alias("_c"))
        tasks = last.select("task_id", *TABLE, "_c.*")
    wanted = tasks.select(
        "task_id",
        F.concat_ws(".", *TABLE).alias("table_key"),
        F.struct(F.col("file_seq"), F.col("next_position")).alias("_at"),
    )
    waiting = pending.filter(F.col("status") == "PENDING").withColumns(
        {
            "table_key": F.explode("blocked_tables"),
            "_at": F.struct(
                F.col("blocked_file_seq").alias("file_seq"), F.col("blocked_position").alias("next_position")
            ),
        }
    )
    if exact:
        return lookup_join(waiting, wanted, ["table_key", "_at"], "inner", spread=["transaction_id"]).drop("_at")
    return lookup_join(waiting.drop("_at"), wanted.drop("_at"), ["table_key"], "inner", spread=["transaction_id"])


def replayable(candidates: DataFrame, states: DataFrame, published: DataFrame) -> DataFrame:
    """Candidates whose blocking tables are all ACTIVE again or being published now."""
    still = (
        states.filter(F.col("status") != "ACTIVE")
        .join(published.select(*TABLE), TABLE, "left_anti")
        .select(F.concat_ws(".", *TABLE).alias("blocker"))
    )
    touching = candidates.select("transaction_id", F.explode("blocked_tables").alias("blocker"))
    held = lookup_join(touching, still, ["blocker"], "left_semi", spread=["transaction_id"])
    return lookup_join(candidates, held.select("transaction_id").distinct(), ["transaction_id"], "left_anti")


def replay_order(pending: DataFrame) -> DataFrame:
    """Pending messages by log position."""
    return pending.orderBy(*REPLAY_ORDER)


def staged_rows(df: DataFrame, spec: TableSpec, task: dict, page_size: int = 500) -> DataFrame:
    """A table re-read for a rebuild, as view rows at the version of the schema change.

    ``task`` holds ``task_id``, ``file`` and ``next_position``. The event index is the row index in
    its page, the transaction id ``rebuild:<task>:<page>``.
    """
    paged = paginate(df.select(*spec.columns), list(spec.primary_key), page_size)
    at = Cutover("rebuild", task["file"], task["next_position"])
    rows = snapshot_rows(paged, spec, at)
    return rows.select(
        *TABLE,
        "row_key",
        F.lit(False).alias("deleted"),
        F.col("after").alias("payload"),
        "file",
        *COORDINATE,
        "event_index",
        F.concat(F.lit(f"rebuild:{task['task_id']}:"), F.col("xid").cast("string")).alias("transaction_id"),
    ).select(*S.VIEW_COLUMNS)


def replace_table(view: DataFrame, staged: DataFrame, spec: TableSpec, keep_tombstones: bool = False) -> DataFrame:
    """The view with all rows of one table replaced by the staged ones."""
    ours = (F.col("database_name") == spec.database) & (F.col("table_name") == spec.table)
    others = view.filter(~ours)
    result = others.select(*S.VIEW_COLUMNS).unionByName(staged.select(*S.VIEW_COLUMNS))
    if not keep_tombstones:
        return result
    kept = view.filter(ours & F.col("deleted")).join(staged.select("row_key"), "row_key", "left_anti")
    return result.unionByName(kept.select(*S.VIEW_COLUMNS))


def rebuild_outcomes(tasks: DataFrame, attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Task and table status after the given finished attempts (task_id, seq, error; null error = success)."""
    summary = attempts.groupBy("task_id").agg(
        F.count_if(F.col("error").isNotNull()).alias("_failures"),
        F.bool_or(F.col("error").isNull()).alias("_done"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("_error"),
    )
    retries = F.coalesce("retry_count", F.lit(0)) + F.coalesce("_failures", F.lit(0))
    failed = F.col("_failures") > 0
    exhausted = failed & (retries >= max_retries)
    status = (
        F.when(F.col("_done"), F.lit("DONE"))
        .when(exhausted, F.lit("FAILED"))
        .when(failed, F.lit("PENDING"))
        .otherwise(F.col("status"))
    )
    table_status = (
        F.when(F.col("_done"), F.lit("ACTIVE"))
        .when(exhausted, F.lit("REBUILD_FAILED"))
        .when(failed, F.lit("REBUILD_REQUIRED"))
    )
    return tasks.join(summary, "task_id", "left").select(
        *[c for c in tasks.columns if c not in ("status", "retry_count", "last_error")],
        status.alias("status"),
        retries.cast("int").alias("retry_count"),
        F.coalesce("_error", "last_error").alias("last_error"),
        table_status.alias("table_status"),
    )


def recover_stale(tasks: DataFrame, now: Column, timeout_seconds: int = 300) -> DataFrame:
    """RUNNING tasks not updated within the timeout go back to PENDING with one more retry."""
    cutoff = now - F.make_dt_interval(secs=F.lit(timeout_seconds))
    stale = (F.col("status") == "RUNNING") & (F.col("updated_at") < cutoff)
    return tasks.withColumns(
        {
            "status": F.when(stale, F.lit("PENDING")).otherwise(F.col("status")),
            "retry_count": F.when(stale, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "last_error": F.when(stale, F.lit(S.STALE_TASK_ERROR)).otherwise(F.col("last_error")),
        }
    )
