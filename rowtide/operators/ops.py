"""Operational summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide import schemas as S


def rebuild_summary(tasks: DataFrame) -> DataFrame:
    """Number of tasks per status, zeros included, as one row."""
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in S.REBUILD_STATUSES])


def rebuild_gauges(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending_rebuild_tasks"),
        F.count_if(F.col("status") == "FAILED").alias("failed_rebuild_tasks"),
    )


def _is(event_type: str, *results: str):
    return (F.col("event_type") == event_type) & F.col("result").isin(*results)


def pipeline_metrics(outcomes: DataFrame) -> DataFrame:
    """Counters over the outcome log; duplicates are counted apart and nowhere else."""
    published = F.col("event_type").isin("DML_TX", "SNAPSHOT_ROW") & (F.col("result") == "PUBLISHED")
    return outcomes.agg(
        F.count_if(published).alias("events_published"),
        F.coalesce(F.sum(F.when(_is("SNAPSHOT_ROW", "PUBLISHED"), F.col("n_rows"))), F.lit(0)).alias(
            "snapshot_rows_sent"
        ),
        F.count_if(_is("DML_TX", "SUCCESS", "BUFFERED")).alias("events_consumed"),
        F.count_if(_is("DML_TX", "FAILED")).alias("events_failed"),
        F.count_if(_is("DML_TX", "DUPLICATE")).alias("events_duplicate"),
        F.count_if(_is("CHECKPOINT", "SAVED")).alias("checkpoint_saves"),
        F.count_if(_is("REBUILD", "STARTED")).alias("rebuilds_started"),
        F.count_if(_is("REBUILD", "SUCCESS")).alias("rebuilds_completed"),
        F.count_if(_is("REBUILD", "FAILED")).alias("rebuilds_failed"),
    )


def rebuild_durations(attempts: DataFrame) -> DataFrame:
    """Count, total and longest duration in milliseconds of successful rebuilds."""
    took = F.unix_millis("finished_at") - F.unix_millis("started_at")
    return attempts.filter(F.col("error").isNull() & F.col("finished_at").isNotNull()).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(took), F.lit(0)).alias("total_ms"),
        F.coalesce(F.max(took), F.lit(0)).alias("max_ms"),
    )


def recent_tasks(tasks: DataFrame, status: str | None = None, n: int = 20) -> DataFrame:
    """Newest rebuild tasks, optionally of one status."""
    chosen = tasks.filter(F.col("status") == status) if status else tasks
    return chosen.orderBy(F.desc("updated_at"), F.desc("task_id")).limit(n)


def recent_full_sync(tasks: DataFrame, n: int = 10) -> DataFrame:
    return tasks.orderBy(F.desc("started_at"), F.desc("database_name"), F.desc("table_name")).limit(n)


def recent_events(outcomes: DataFrame, n: int = 50) -> DataFrame:
    """Newest outcomes, newest first."""
    return outcomes.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def connector_status(connectors: DataFrame, checkpoints: DataFrame, tasks: DataFrame, strategy: str) -> DataFrame:
    """One row per connector: strategy, checkpoint, running and failed rebuilds."""
    stored = checkpoints.select("connector", "file", "position")
    with_status = lambda s: tasks.filter(F.col("status") == s).agg(F.count("*")).scalar()
    return (
        connectors.select("connector")
        .join(stored, "connector", "left")
        .select(
            "connector",
            F.lit(strategy).alias("startup_strategy"),
            "file",
            "position",
            F.col("file").isNotNull().alias("checkpoint_present"),
            with_status("RUNNING").alias("running_rebuilds"),
            with_status("FAILED").alias("failed_rebuilds"),
        )
    )


def overview(
    checkpoints: DataFrame, full_syncs: DataFrame, tasks: DataFrame, states: DataFrame, outcomes: DataFrame
) -> dict[str, DataFrame]:
    """The tables of a status page."""
    return {
        "checkpoint": checkpoints,
        "full_sync_tasks": recent_full_sync(full_syncs, 5),
        "rebuild_summary": rebuild_summary(tasks),
        "schema_states": states.orderBy("database_name", "table_name"),
        "recent_events": recent_events(outcomes),
    }

