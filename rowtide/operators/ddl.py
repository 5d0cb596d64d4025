"""Schema changes: classification, table state, transaction routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide import schemas as S
from rowtide.functions.ddl import COLUMNS, changed_columns, column_changes, ddl_target, ddl_type, is_destructive
from rowtide.functions.values import java_trim
from rowtide.functions.versions import file_seq
from rowtide.operators import fold
from rowtide.operators.ordered import arrival_blocks, carry_last
from rowtide.session import lookup_join

TABLE = ["database_name", "table_name"]
COORDINATE = ["file_seq", "next_position"]


def classify_ddl(statements: DataFrame) -> DataFrame:
    """Add ``ddl_type`` (null: ignored) and ``destructive`` to rows with a ``sql`` column."""
    kind = ddl_type(F.col("sql"))
    return statements.withColumns({"ddl_type": kind, "destructive": is_destructive(kind)})


def resolve_ddl_table(statements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Statements that alter a configured table, with the table's configured spelling.

    ``database_name`` is the statement's default database on input. When several configured
    tables differ only in case, the first configured one is taken.
    """
    target = ddl_target(F.col("database_name"), F.col("sql"))
    keyed = statements.withColumn("_t", target).withColumns(
        {"_db": F.col("_t.database_key"), "_tbl": F.col("_t.table_key")}
    )
    names = (
        catalog.select(*TABLE, "table_order")
        .groupBy(F.lower(java_trim("database_name")).alias("_db"), F.lower(java_trim("table_name")).alias("_tbl"))
        .agg(F.min_by(F.struct(*TABLE), "table_order").alias("_name"))
    )
    joined = keyed.join(F.broadcast(names), ["_db", "_tbl"])
    return joined.withColumns({c: F.col(f"_name.{c}") for c in TABLE}).drop("_t", "_db", "_tbl", "_name")


def schema_change_events(log: DataFrame, catalog: DataFrame, now: Column | None = None) -> DataFrame:
    """Schema-change events of a raw log: one per recognised ALTER of a configured table."""
    queries = log.filter((F.col("type") == "QUERY") & F.col("sql").isNotNull())
    changes = classify_ddl(resolve_ddl_table(queries, catalog)).filter(F.col("ddl_type").isNotNull())
    fallback = now if now is not None else F.unix_millis(F.current_timestamp())
    return changes.select(
        F.concat_ws(":", F.lit("ddl"), "file", "pos").alias("event_id"),
        "connector",
        *TABLE,
        "ddl_type",
        F.col("sql").alias("raw_sql"),
        "file",
        file_seq("file").alias("file_seq"),
        F.col("pos").alias("next_position"),
        F.when(F.col("ts_ms") > 0, F.col("ts_ms")).otherwise(fallback).alias("ts_ms"),
    )


def layout_history(log: DataFrame, catalog: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Columns, key and bare columns of each table after every statement of the log that changes them.

    The statements of a table are applied in log order to its newest ``stored`` layout, else to the catalogue's
    columns. Every ALTER TABLE on a configured table counts, also one that ``classify_ddl`` does not announce, since
    rows behind it carry its columns. A table's statements are gathered in one row: there is one per schema change.
    """
    queries = log.filter((F.col("type") == "QUERY") & F.col("sql").isNotNull())
    changes = resolve_ddl_table(queries, catalog).withColumn("changes", column_changes(F.col("sql"))).filter(F.size("changes") > 0)
    statement = F.struct(file_seq("file").alias("file_seq"), F.col("pos").alias("position"), "seq", "changes", "sql")
    listed = changes.groupBy(*TABLE).agg(F.array_sort(F.collect_set(statement)).alias("statements"))
    start = catalog.select(*TABLE, F.struct("columns", "primary_keys", "bare").cast(COLUMNS).alias("start"))
    if stored is not None:
        newest = stored.groupBy(*TABLE).agg(
            F.max_by(F.struct("columns", "primary_keys", "bare").cast(COLUMNS), F.struct("file_seq", "position")).alias("_last"),
            F.max(F.struct("file_seq", "position")).alias("_at"),
        )
        start = start.join(newest, TABLE, "left").select(*TABLE, F.coalesce("_last", "start").alias("start"), "_at")
    else:
        start = start.withColumn("_at", F.lit(None).cast("struct<file_seq:bigint, position:bigint>"))
    joined = listed.join(F.broadcast(start), TABLE)
    # A statement at or before the newest stored layout has been applied already.
    here = lambda s: F.struct(s["file_seq"], s["position"])
    new = F.filter("statements", lambda s: F.col("_at").isNull() | (here(s) > F.col("_at")))
    entry = "struct<file_seq:bigint, position:bigint, columns:array<string>, primary_keys:array<string>, bare:array<string>, ddl_sql:string>"
    none = F.array().cast(f"array<{entry}>")

    def one(held, s):
        now = changed_columns(held["now"], s["changes"])
        made = F.struct(s["file_seq"], s["position"], now["columns"], now["primary_keys"], now["bare"], s["sql"]).cast(entry)
        out = F.when(now == held["now"], held["out"]).otherwise(F.concat(held["out"], F.array(made)))
        return F.struct(now.alias("now"), out.alias("out"))

    history = F.aggregate(new, F.struct(F.col("start").alias("now"), none.alias("out")), one, lambda held: held["out"])
    return joined.select(*TABLE, F.explode(history).alias("_l")).select(*TABLE, "_l.*")


def schema_state(changes: DataFrame, status_log: DataFrame | None = None) -> DataFrame:
    """Newest state per table from its schema changes and an optional log of status changes.

    The newest destructive change decides status and coordinate; a later additive one updates the
    DDL text only while a rebuild is outstanding, so it never unblocks a table. ``status_log`` rows
    (table, coordinate, status, seq) come from rebuild runs and count only for the coordinate they
    name.
    """
    destructive = is_destructive(F.col("ddl_type"))
    coordinate = F.struct(*COORDINATE)
    newest = changes.groupBy(*TABLE).agg(
        F.max_by(F.struct("ddl_type", "raw_sql", "file", *COORDINATE), coordinate).alias("_last"),
        F.max_by(
            F.struct("ddl_type", "raw_sql", "file", *COORDINATE), F.when(destructive, coordinate)
        ).alias("_blocking"),
    )
    if status_log is None:
        joined = newest.withColumn("_status", F.lit(None).cast("string"))
    else:
        runs = status_log.groupBy(*TABLE, *COORDINATE).agg(F.max_by("status", "seq").alias("_status"))
        keyed = newest.withColumns({c: F.col(f"_blocking.{c}") for c in COORDINATE})
        joined = keyed.join(runs, [*TABLE, *COORDINATE], "left").drop(*COORDINATE)
    blocked = F.col("_blocking").isNotNull()
    status = F.when(blocked, F.coalesce("_status", F.lit("REBUILD_REQUIRED"))).otherwise(F.lit("ACTIVE"))
    # An active table shows its newest change; a blocked one keeps the change it waits for.
    held = blocked & (status != "ACTIVE")
    shown = F.when(held, F.col("_blocking")).otherwise(F.col("_last"))
    return joined.select(
        *TABLE,
        status.alias("status"),
        shown["file"].alias("file"),
        shown["file_seq"].alias("file_seq"),
        shown["next_position"].alias("next_position"),
        shown["ddl_type"].alias("ddl_type"),
        shown["raw_sql"].alias("ddl_sql"),
    )


def intake_ddl(changes: DataFrame) -> DataFrame:
    """New rebuild tasks: one PENDING task per destructive change."""
    created = F.timestamp_millis("ts_ms")
    return changes.filter(is_destructive(F.col("ddl_type"))).select(
        task_id().alias("task_id"),
        *TABLE,
        "file",
        *COORDINATE,
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("last_error"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def task_id() -> Column:
    return F.concat(
        F.concat_ws(".", *TABLE), F.lit(":"), F.col("file"), F.lit(":"), F.col("next_position").cast("string")
    )


def touched_tables(transactions: DataFrame) -> DataFrame:
    """Distinct ``database.table`` names of each message, first seen first."""
    names = F.array_distinct(F.transform("events", lambda e: F.concat_ws(".", e["database"], e["table"])))
    return transactions.withColumn("touched", names)


def blocking_versions(transactions: DataFrame, states: DataFrame) -> DataFrame:
    """Transactions that touch a table which is not ACTIVE, with the tables and the newest coordinate.

    Only messages that name a blocked table travel further than the first stage.
    """
    blocked = states.filter(F.col("status") != "ACTIVE").select(
        F.concat_ws(".", *TABLE).alias("table_key"),
        F.col("file").alias("blocked_file"),
        F.col("file_seq").alias("blocked_file_seq"),
        F.col("next_position").alias("blocked_position"),
    )
    pairs = touched_tables(transactions).select("transaction_id", F.explode("touched").alias("table_key"))
    hits = lookup_join(pairs, blocked, ["table_key"], "inner", spread=["transaction_id"])
    newest = F.max_by(
        F.struct("blocked_file", "blocked_file_seq", "blocked_position"),
        F.struct("blocked_file_seq", "blocked_position"),
    )
    return (
        hits.groupBy("transaction_id")
        .agg(F.array_sort(F.collect_set("table_key")).alias("blocking_tables"), newest.alias("_b"))
        .select("transaction_id", "blocking_tables", "_b.*")
    )


def route(transactions: DataFrame, states: DataFrame, done: DataFrame) -> DataFrame:
    """Add ``route`` to each message: BUFFERED, DUPLICATE or APPLIED, one answer per transaction."""
    return _routed(transactions, blocking_versions(transactions, states), done)


def route_batch(
    transactions: DataFrame, changes: DataFrame, states: DataFrame, done: DataFrame, block_size: int = 1_000_000
) -> DataFrame:
    """Route a batch with the cheapest plan that gives the answer of ``route_in_order``.

    Without a destructive change in the batch the stored states hold throughout.
    """
    if changes.filter(is_destructive(F.col("ddl_type"))).limit(1).count():
        return route_in_order(transactions, changes, states, done, block_size)
    return route(transactions, states, done)


def route_unblocked(transactions: DataFrame, done: DataFrame) -> DataFrame:
    """Route a batch while no table is held back: only the done set is looked at."""
    judged = fold.mark_done(transactions, done)
    return judged.withColumn("route", F.when(F.col("is_done"), "DUPLICATE").otherwise("APPLIED")).drop("is_done")


def _routed(transactions: DataFrame, blocking: DataFrame, done: DataFrame) -> DataFrame:
    judged = lookup_join(touched_tables(fold.mark_done(transactions, done)), blocking, ["transaction_id"])
    return judged.withColumn("route", _route()).drop("is_done")


def _route() -> Column:
    return (
        F.when(F.col("blocking_tables").isNotNull(), F.lit("BUFFERED"))
        .when(F.col("is_done"), F.lit("DUPLICATE"))
        .otherwise(F.lit("APPLIED"))
    )


def route_in_order(
    transactions: DataFrame,
    changes: DataFrame,
    stored_states: DataFrame,
    done: DataFrame,
    block_size: int = 1_000_000,
) -> DataFrame:
    """Route messages that are interleaved with schema changes: a change blocks only later arrivals.

    The state of a table at a message is the latest destructive change that arrived before it,
    else the stored state. Lookups run in blocks of arrival numbers, so a table that most
    messages touch is still spread over many tasks. Messages are expected to be de-duplicated.
    """
    pairs = touched_tables(transactions).select(
        "arrival", "transaction_id", F.explode("touched").alias("table_key"), F.lit(None).cast(_STATE).alias("state")
    )
    seeds = stored_states.select(
        F.lit(-1).cast("bigint").alias("arrival"),
        F.lit(None).cast("string").alias("transaction_id"),
        F.concat_ws(".", *TABLE).alias("table_key"),
        F.struct("status", "file", *COORDINATE).cast(_STATE).alias("state"),
    )
    arrived = changes.filter(is_destructive(F.col("ddl_type"))).select(
        "arrival",
        F.lit(None).cast("string").alias("transaction_id"),
        F.concat_ws(".", *TABLE).alias("table_key"),
        F.struct(F.lit("REBUILD_REQUIRED").alias("status"), F.col("file"), *COORDINATE).cast(_STATE).alias("state"),
    )
    ordered = arrival_blocks(pairs.unionByName(seeds).unionByName(arrived), "arrival", block_size)
    known = carry_last(ordered, ["table_key"], ["arrival"], F.col("state"), "current")
    hits = known.filter(F.col("transaction_id").isNotNull() & (F.col("current.status") != "ACTIVE"))
    blocking = (
        hits.groupBy("transaction_id")
        .agg(
            F.array_sort(F.collect_set("table_key")).alias("blocking_tables"),
            F.max_by("current", F.struct("current.file_seq", "current.next_position")).alias("_b"),
        )
        .select(
            "transaction_id",
            "blocking_tables",
            F.col("_b.file").alias("blocked_file"),
            F.col("_b.file_seq").alias("blocked_file_seq"),
            F.col("_b.next_position").alias("blocked_position"),
        )
    )
    return _routed(transactions, blocking, done)


_STATE = "struct<status:string, file:string, file_seq:bigint, next_position:bigint>"


def pending_rows(routed: DataFrame) -> DataFrame:
    """Buffered messages as rows of the pending table, the whole message kept."""
    return routed.filter(F.col("route") == "BUFFERED").select(
        "transaction_id",
        "fragment",
        "connector",
        "file",
        "file_seq",
        "next_position",
        F.col("value").alias("payload"),
        F.col("touched").alias("blocked_tables"),
        "blocking_tables",
        "blocked_file",
        "blocked_file_seq",
        "blocked_position",
        F.lit("PENDING").alias("status"),
    )
