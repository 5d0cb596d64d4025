"""Transactions, resume positions and start positions from the raw log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide import schemas as S
from rowtide.functions.versions import file_seq
from rowtide.operators import shape
from rowtide.operators.ordered import LOG_ORDER, Blocks, commit_scan, with_blocks
from rowtide.session import lookup_join, materialize

MAX_EVENTS = 10_000


# What identifies a log entry.
COORDINATE = ["connector", "file", "pos", "seq"]


def commit_groups(
    log: DataFrame, catalog: DataFrame, blocks: Blocks = Blocks(), images: bool = True
) -> DataFrame:
    """Row and commit events with named tables, their commit group and the closing commit.

    Everything is found on entries without their row images, which are written once, so the windows neither read
    the log again nor carry images. With ``images`` they are joined back by their coordinate, the only exchange
    they meet; without, commits and checkpoints make do with their count (``n_rows``). A coordinate names one entry.
    """
    relevant = log.filter(F.col("type").isin("TABLE_MAP", "XID", *shape.ROW_TYPES))
    is_row = F.col("type").isin(*shape.ROW_TYPES)
    narrow = relevant.withColumn("n_rows", F.when(is_row, F.size("rows"))).drop("rows", "sql")
    resolved = shape.resolve_table_map(materialize(with_blocks(narrow, blocks), "entries"))
    marked = shape.mark_configured(resolved, catalog)
    is_commit = F.col("type") == "XID"
    header = F.struct("xid", "file", F.col("pos").alias("next_position"), F.col("ts_ms"))
    n_rows = F.when(F.col("configured"), F.coalesce("n_rows", F.lit(0))).otherwise(0).cast("bigint")
    grouped = commit_scan(marked, is_commit, header, n_rows)
    if not images:
        return grouped
    return grouped.join(relevant.filter(is_row).select(*COORDINATE, "rows"), COORDINATE, "left")


def transaction_id(connector, file, xid, next_position) -> Column:
    return F.concat_ws(":", connector, file, xid, next_position)


def event_time(ts_ms: Column, now: Column | None = None) -> Column:
    """Event time in milliseconds, the current time when the log carries none."""
    fallback = now if now is not None else F.unix_millis(F.current_timestamp())
    return F.when(ts_ms > 0, ts_ms).otherwise(fallback)


def assemble_changes(
    grouped: DataFrame, catalog: DataFrame, on_pk_change: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """Committed row changes (one row each, with header and event index) and the open tail.

    Works on the output of ``commit_groups``. Changes stay exploded: a transaction of any size is
    spread over many tasks, and arrays are built only for messages (``assemble_transactions``).
    """
    rows, _ = shape.check_pk_stable(_keyed_rows(grouped, catalog), on_pk_change)
    return _changes(rows), grouped.filter(F.col("commit").isNull())


def mutated_changes(grouped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Committed updates that change their primary key, in the form of ``assemble_changes``."""
    return _changes(shape.check_pk_stable(_keyed_rows(grouped, catalog), "quarantine")[1])


def _keyed_rows(grouped: DataFrame, catalog: DataFrame) -> DataFrame:
    committed = grouped.filter(F.col("commit").isNotNull() & F.col("configured"))
    rows = shape.row_images(shape.join_metadata(committed, catalog))
    return shape.with_keys(shape.name_columns(rows))


def _changes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "connector",
        F.col("commit.file").alias("file"),
        file_seq(F.col("commit.file")).alias("file_seq"),
        F.col("commit.xid").alias("xid"),
        F.col("commit.next_position").alias("next_position"),
        event_time(F.col("commit.ts_ms")).alias("ts_ms"),
        transaction_id(
            F.col("connector"), F.col("commit.file"), F.col("commit.xid"), F.col("commit.next_position")
        ).alias("transaction_id"),
        (F.col("first_index") + F.col("row_pos")).alias("event_index"),
        *shape.TABLE,
        "op",
        "primary_key",
        shape.image_json(F.col("before")).alias("before"),
        shape.image_json(F.col("after")).alias("after"),
        shape.image_json(F.col("primary_key")).alias("primary_key_json"),
    )


def fragment_of(event_index: Column, max_events: int = MAX_EVENTS) -> Column:
    """Part number of a row in a transaction cut every ``max_events`` rows."""
    return F.floor(event_index / max_events).cast("int")


def assemble_transactions(changes: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """One row per transaction with its changes as an ordered array.

    A transaction longer than ``max_events`` rows becomes several rows with the same id, ascending
    ``fragment`` numbers and their count in ``fragments``, so no array (and no task) grows with a
    transaction; readers wait until all parts are there (``envelope.split_incomplete``).
    """
    header = ["connector", "file", "file_seq", "xid", "next_position"]
    event = F.struct("event_index", *shape.TABLE, "op", "primary_key_json", "before", "after")
    numbered = changes.withColumn("fragment", fragment_of(F.col("event_index"), max_events))
    parts = numbered.groupBy("transaction_id", "fragment", *header).agg(
        F.min("ts_ms").alias("ts_ms"), F.array_sort(F.collect_list(event)).alias("events")
    )
    # Written once; how many parts a transaction has is then read from two columns of them.
    parts = materialize(parts, "parts")
    cut = (
        parts.groupBy("transaction_id")
        .agg(F.count("*").cast("int").alias("fragments"), F.max("fragment").alias("_last"))
        .filter("_last > 0")
        .drop("_last")
    )
    return lookup_join(parts, cut, ["transaction_id"]).fillna(1, ["fragments"])


def commits(grouped: DataFrame) -> DataFrame:
    """One row per commit: its position, row count, first table, and what it ignored."""
    internal = F.col("table_name").isin(*S.INTERNAL_PROGRESS_TABLES)
    is_row = F.col("type") != "XID"
    ignored = is_row & ~F.col("configured")
    return (
        grouped.filter(F.col("commit").isNotNull())
        .groupBy("connector", "commit_group")
        .agg(
            F.max("commit").alias("commit"),
            F.coalesce(F.sum(F.when(is_row & F.col("configured"), F.col("n_rows"))), F.lit(0)).alias("n_rows"),
            F.count_if(ignored).alias("n_ignored"),
            F.count_if(ignored & ~internal).alias("n_ignored_external"),
            F.min_by(
                F.struct(*shape.TABLE), F.when(F.col("configured"), F.struct(*LOG_ORDER))
            ).alias("first_table"),
        )
        .select(
            "connector", "commit_group", "commit.*", "n_rows", "n_ignored", "n_ignored_external", "first_table"
        )
    )


def advances_checkpoint() -> Column:
    """A commit moves the checkpoint unless all it holds is rows of internal progress tables."""
    return (F.col("n_rows") > 0) | (F.col("n_ignored") == 0) | (F.col("n_ignored_external") > 0)


def advance_checkpoint(commit_rows: DataFrame, schema_changes: DataFrame | None = None) -> DataFrame:
    """Resume position per connector after the given commits and accepted schema changes."""
    points = commit_rows.filter(advances_checkpoint()).select(
        "connector", "file", F.col("next_position").alias("position")
    )
    if schema_changes is not None:
        points = points.unionByName(
            schema_changes.select("connector", "file", F.col("next_position").alias("position"))
        )
    points = points.withColumn("file_seq", file_seq("file"))
    newest = F.max_by(F.struct("file", "file_seq", "position"), F.struct("file_seq", "position"))
    return points.groupBy("connector").agg(newest.alias("p")).select("connector", "p.*")


def after_checkpoint(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Log entries behind the stored position of their connector; all of them when none is stored."""
    stored = checkpoints.select(
        "connector", F.struct(F.col("file_seq"), F.col("position").alias("pos")).alias("_resume")
    )
    joined = lookup_join(log, stored, ["connector"], spread=["file", "pos", "seq"])
    here = F.struct(file_seq("file").alias("file_seq"), F.col("pos"))
    return joined.filter(F.col("_resume").isNull() | (here > F.col("_resume"))).drop("_resume")


def log_head(log: DataFrame) -> DataFrame:
    """Newest position of each connector's log."""
    seq = file_seq("file")
    newest = F.max(F.struct(seq.alias("file_seq"), F.col("pos").alias("position"), F.col("file")))
    heads = log.groupBy("connector").agg(newest.alias("p"))
    return heads.select("connector", "p.file", "p.file_seq", "p.position")


def resolve_start(
    connectors: DataFrame, checkpoints: DataFrame, head: DataFrame, strategy: str, checkpointing: bool = True
) -> DataFrame:
    """Where each connector starts: stored checkpoint, else the log head.

    ``action`` says what to do: RESUME, LATEST, SNAPSHOT (take a snapshot first, its cutover being
    this position) or DEFAULT (checkpointing off, no position).
    """
    if strategy not in ("LATEST", "SNAPSHOT_THEN_INCREMENTAL"):
        raise ValueError(f"unsupported startup strategy: {strategy}")
    if not checkpointing:
        if strategy == "SNAPSHOT_THEN_INCREMENTAL":
            raise ValueError("snapshot-then-incremental startup requires checkpointing")
        return connectors.select(
            "connector",
            F.lit("DEFAULT").alias("action"),
            F.lit(None).cast("string").alias("file"),
            F.lit(None).cast("bigint").alias("position"),
        )
    fresh = "LATEST" if strategy == "LATEST" else "SNAPSHOT"
    stored = checkpoints.select("connector", F.struct("file", "position").alias("stored"))
    newest = head.select("connector", F.struct("file", "position").alias("newest"))
    start = F.coalesce("stored", "newest")
    return (
        connectors.select("connector")
        .join(stored, "connector", "left")
        .join(newest, "connector", "left")
        .select(
            "connector",
            F.when(F.col("stored").isNotNull(), F.lit("RESUME")).otherwise(F.lit(fresh)).alias("action"),
            start["file"].alias("file"),
            start["position"].alias("position"),
        )
    )
