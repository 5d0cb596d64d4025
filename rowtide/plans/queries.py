"""Registered queries: each runs one or more operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide import schemas as S
from rowtide.functions.values import utc_wall
from rowtide.functions.versions import done_key, is_newer, row_version, view_action
from rowtide.operators import assemble, control, ddl, envelope, fold, ops, rebuild, shape, snapshot
from rowtide.operators.ordered import fit_blocks, with_blocks
from rowtide.plans import feed
from rowtide.session import materialize, scratch_path
from rowtide.sources.catalog import TableSpec, attach_layouts, load_catalog
from rowtide.sources.changelog import read_change_log
from rowtide.sources.envelopes import read_envelopes, write_envelopes
from rowtide.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _map_text(column: str):
    """A map as ``k=v`` pairs in its own order."""
    pairs = F.transform(
        F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    return F.array_join(pairs, ";")


# --- latest state -----------------------------------------------------------------------------


@query
def latest_state_meta(spark, sf):
    return fold.fold_latest(feed.changes(spark, sf))


@query
def latest_state_stale_feed(spark, sf):
    return fold.fold_latest(feed.stale_changes(spark, sf))


@query
def latest_state_simple(spark, sf):
    view = fold.live(fold.fold_arrival(feed.stale_changes(spark, sf)))
    return view.select("database_name", "table_name", "row_key", "payload", "transaction_id")


@query
def keyed_records(spark, sf):
    return fold.keyed_records(fold.fold_latest(feed.changes(spark, sf)))


@query
def keyed_records_table_scope(spark, sf):
    view = fold.live(fold.fold_latest(feed.changes(spark, sf)))
    return fold.keyed_records(view, "TABLE").select("business_key", "payload", "meta_key")


@query
def tombstones(spark, sf):
    view = fold.tombstones(fold.fold_latest(feed.changes(spark, sf)))
    return view.select("database_name", "table_name", "row_key", "file", "next_position", "event_index")


@query
def live_rows_per_table(spark, sf):
    view = fold.fold_latest(feed.changes(spark, sf))
    return view.groupBy("database_name", "table_name").agg(
        F.count_if(~F.col("deleted")).alias("n_live"), F.count_if("deleted").alias("n_deleted")
    )


@query
def row_versions(spark, sf):
    """Compare every change with the newest one of its key."""
    rows = feed.changes(spark, sf)
    newest = fold.fold_latest(rows).select(*fold.KEY, row_version(*fold.VERSION).alias("stored"))
    compared = rows.join(newest, fold.KEY).withColumn("newer", is_newer(row_version(*fold.VERSION), F.col("stored")))
    return compared.groupBy("table_name", view_action("op").alias("action"), "newer").agg(F.count("*").alias("n"))


@query
def merge_stored_view(spark, sf):
    """The first half as stored view, merged with a second half that repeats older changes."""
    half = feed.half(spark, sf)
    stored = fold.fold_latest(feed.changes(spark, sf).filter(F.col("event_id") < half))
    late = feed.stale_changes(spark, sf).filter(
        (F.col("event_id") >= half) | (F.col("arrival") >= 1_000_000_000)
    )
    return fold.merge_view(stored, fold.fold_latest(late))


@query
def override_stored_view(spark, sf):
    """The same halves in arrival-order mode: late changes win."""
    half = feed.half(spark, sf)
    stored = fold.live(fold.fold_arrival(feed.changes(spark, sf).filter(F.col("event_id") < half)))
    late = feed.stale_changes(spark, sf).filter(
        (F.col("event_id") >= half) | (F.col("arrival") >= 1_000_000_000)
    )
    view = fold.override_view(stored, fold.fold_arrival(late))
    return view.select("database_name", "table_name", "row_key", "payload", "transaction_id")


# --- raw log ----------------------------------------------------------------------------------


def _grouped(spark, sf, images=True):
    log = feed.raw_log(spark, sf)
    return assemble.commit_groups(log, feed.catalog(spark), fit_blocks(feed_files(spark, sf)), images)


def feed_files(spark, sf):
    """File names alone: enough to size the blocks."""
    return feed.events(spark, sf).select(feed.file_name().alias("file"))


def _changes_of_log(spark, sf):
    return assemble.assemble_changes(_grouped(spark, sf), feed.catalog(spark), on_pk_change="quarantine")[0]


@query
def table_map_resolved(spark, sf):
    log = with_blocks(feed.raw_log(spark, sf), fit_blocks(feed_files(spark, sf)))
    resolved = shape.resolve_table_map(log).filter(F.col("type").isin(*shape.ROW_TYPES))
    return resolved.select("file", "pos", "type", "table_id", "database_name", "table_name")


@query
def commit_groups(spark, sf):
    return _grouped(spark, sf).select(
        "file", "pos", "type", "table_name", "configured", "commit_group", "first_index",
        F.col("commit.xid").alias("commit_xid"), F.col("commit.next_position").alias("commit_position"),
    )


@query
def event_index(spark, sf):
    return _changes_of_log(spark, sf).select(
        "transaction_id", "event_index", "table_name", "op", F.col("primary_key")["id"].alias("id")
    )


@query
def transactions(spark, sf):
    assembled = assemble.assemble_transactions(_changes_of_log(spark, sf))
    text = F.transform(
        "events", lambda e: F.concat_ws(":", e["event_index"], e["op"], e["table_name"], e["primary_key_json"])
    )
    return assembled.select(
        "transaction_id", "file", "xid", "next_position", "ts_ms",
        F.size("events").cast("bigint").alias("n_events"), F.array_join(text, ",").alias("events_text"),
    )


@query
def transaction_fragments(spark, sf):
    """The same transactions cut every two rows."""
    assembled = assemble.assemble_transactions(_changes_of_log(spark, sf), max_events=2)
    return assembled.select(
        "transaction_id", F.col("fragment").cast("bigint").alias("fragment"),
        F.size("events").cast("bigint").alias("n_events"),
        F.col("events")[0]["event_index"].alias("first_event"),
    )


@query
def transaction_ids(spark, sf):
    changes = _changes_of_log(spark, sf)
    return changes.groupBy("transaction_id").agg(F.count("*").alias("n_rows"), F.min("ts_ms").alias("ts_ms"))


@query
def commits(spark, sf):
    rows = assemble.commits(_grouped(spark, sf, images=False))
    return rows.select(
        "commit_group", "xid", "file", "next_position", "n_rows", "n_ignored", "n_ignored_external",
        assemble.advances_checkpoint().alias("advances"),
    )


@query
def connector_checkpoint(spark, sf):
    grouped = _grouped(spark, sf, images=False)
    ddl_events = ddl.schema_change_events(feed.raw_log(spark, sf), feed.catalog(spark))
    return assemble.advance_checkpoint(assemble.commits(grouped), ddl_events)


def _stored_checkpoint(spark, sf):
    """The position in the middle of the log."""
    half = feed.half(spark, sf)
    middle = feed.events(spark, sf).filter(F.col("event_id") < half)
    seq = F.col("file_seq")
    newest = F.max_by(
        F.struct(feed.file_name().alias("file"), seq.alias("file_seq"), F.col("next_position").alias("position")),
        F.struct(seq, "next_position"),
    )
    return middle.agg(newest.alias("p")).select(F.lit(feed.CONNECTOR).alias("connector"), "p.*")


@query
def resume_rows(spark, sf):
    rest = assemble.after_checkpoint(feed.raw_log(spark, sf), _stored_checkpoint(spark, sf))
    return rest.select("file", "pos", "type", "table_id")


@query
def start_position(spark, sf):
    """Stored position of one connector, log head of another that has none."""
    connectors = spark.createDataFrame([(feed.CONNECTOR,), ("fresh",)], "connector string")
    head = assemble.log_head(feed.raw_log(spark, sf))
    heads = head.unionByName(head.withColumn("connector", F.lit("fresh")))
    return assemble.resolve_start(
        connectors, _stored_checkpoint(spark, sf), heads, "SNAPSHOT_THEN_INCREMENTAL"
    )


# --- row shaping --------------------------------------------------------------------------------


def _images(spark, sf):
    grouped = _grouped(spark, sf).filter("configured")
    rows = shape.row_images(shape.join_metadata(grouped, feed.catalog(spark)))
    return shape.with_keys(shape.name_columns(rows))


@query
def named_rows(spark, sf):
    return _images(spark, sf).select(
        "file", "pos", F.col("row_pos").cast("bigint").alias("row_pos"), "table_name",
        _map_text("after").alias("after_text"), _map_text("before").alias("before_text"),
    )


@query
def table_layouts(spark, sf):
    """Columns of every table after each statement that changed them."""
    found = ddl.layout_history(feed.altered_log(spark, sf), feed.catalog(spark))
    return found.select(
        "table_name", "file_seq", "position", F.array_join("columns", ",").alias("columns"),
        F.array_join("primary_keys", ",").alias("primary_keys"), F.array_join(F.array_sort("bare"), ",").alias("bare"),
    )


@query
def layout_change(spark, sf):
    """Images of the user table before and after its layout changes, as JSON by name; layouts read from the log."""
    log = feed.altered_log(spark, sf)
    history = attach_layouts(feed.catalog(spark), ddl.layout_history(log, feed.catalog(spark)))
    blocks = fit_blocks(feed_files(spark, sf))
    grouped = assemble.commit_groups(log, history, blocks).filter("configured")
    rows = shape.name_columns(shape.row_images(shape.join_metadata(grouped, history))).filter("table_name = 'user'")
    return rows.select(
        "file", "pos", F.col("row_pos").cast("bigint").alias("row_pos"), _map_text("after").alias("after_text"),
        shape.image_json(F.col("before")).isNotNull().alias("has_before"),
    )


@query
def row_images(spark, sf):
    return _images(spark, sf).select(
        "file", "pos", F.col("row_pos").cast("bigint").alias("row_pos"), "op",
        _map_text("primary_key").alias("key_text"),
        F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"),
    )


@query
def pk_mutations(spark, sf):
    _, bad = shape.check_pk_stable(_images(spark, sf), "quarantine")
    return bad.select(
        "file", "pos", F.col("row_pos").cast("bigint").alias("row_pos"),
        F.col("before")["id"].alias("old_id"), F.col("after")["id"].alias("new_id"),
    )


@query
def normalized_values(spark, sf):
    typed = feed.events(spark, sf).select("event_id", "ts", F.col("wall").cast("date").alias("day"), "event_type")
    return shape.normalize_values(typed)


@query
def normalized_binary(spark, sf):
    documents = feed.read(spark, sf, "documents")
    return shape.normalize_values(documents.select("doc_id", F.encode("text", "UTF-8").alias("body")))


def _log_rows(spark, sf):
    log = with_blocks(feed.raw_log(spark, sf), fit_blocks(feed_files(spark, sf)))
    return shape.resolve_table_map(log).filter(F.col("type").isin(*shape.ROW_TYPES))


@query
def whitelist_rows(spark, sf):
    rows = shape.filter_tables(_log_rows(spark, sf), feed.catalog(spark))
    return rows.select("file", "pos", "type", "table_name")


@query
def ignored_tables(spark, sf):
    rows = shape.ignored_rows(_log_rows(spark, sf), feed.catalog(spark))
    return rows.groupBy("database_name", "table_name", "type").agg(F.count("*").alias("n_events"))


# --- messages -----------------------------------------------------------------------------------


@query
def envelopes(spark, sf):
    return feed.as_messages(feed.changes(spark, sf)).select("arrival", "key", "value")


@query
def envelope_decode(spark, sf):
    good, _ = envelope.decode_envelopes(feed.messages(spark, sf))
    rows = envelope.explode_rows(envelope.split_messages(good)[1])
    return rows.select(
        "arrival", F.col("list_pos").cast("bigint").alias("list_pos"), "transaction_id", "database_name",
        "table_name", "event_index", "op", "row_key", "before", "after",
    )


@query
def poison_messages(spark, sf):
    _, poison = envelope.decode_envelopes(feed.messages(spark, sf))
    return poison.select("arrival", "key", "reason")


@query
def message_split(spark, sf):
    good, _ = envelope.decode_envelopes(feed.messages(spark, sf))
    return good.select("arrival", envelope.message_kind().alias("kind"))


# What transactions are judged by; their rows and texts stay out of what is written.
JUDGED = ["transaction_id", "arrival", "fragment", "problem"]


@query
def rejected_transactions(spark, sf):
    _, rejected = envelope.validate_transactions(feed.transactions_of(feed.messages(spark, sf), *JUDGED))
    return rejected.select("transaction_id", "arrival", "reason")


@query
def valid_transactions(spark, sf):
    n_events = F.size("events").cast("bigint").alias("n_events")
    ok, _ = envelope.validate_transactions(feed.transactions_of(feed.messages(spark, sf), *JUDGED, n_events))
    return ok.select("transaction_id", "arrival", "n_events")


@query
def dedupe_transactions(spark, sf):
    first = fold.dedupe_transactions(feed.transactions_of(feed.repeated_messages(spark, sf)))
    return first.select("transaction_id", "arrival", "xid", F.size("events").cast("bigint").alias("n_events"))


@query
def done_anti_join(spark, sf):
    txns = feed.transactions_of(feed.as_messages(feed.changes(spark, sf)))
    done = feed.done_ids(spark, sf)
    new, duplicate = fold.drop_done(txns, done)
    return (
        new.select("transaction_id", done_key("transaction_id").alias("done_key"), F.lit("APPLIED").alias("outcome"))
        .unionByName(
            duplicate.select(
                "transaction_id", done_key("transaction_id").alias("done_key"), F.lit("DUPLICATE").alias("outcome")
            )
        )
    )


@query
def synced_view(spark, sf):
    """Messages to view: decode, validate, de-duplicate, drop applied ones, fold."""
    ok, _ = envelope.validate_transactions(feed.transactions_of(feed.messages(spark, sf)))
    new, _ = fold.drop_done(fold.dedupe_transactions(ok), feed.done_ids(spark, sf))
    return fold.fold_latest(envelope.explode_rows(new))


# --- schema changes and routing -------------------------------------------------------------------


@query
def ddl_classified(spark, sf):
    statements = feed.raw_log(spark, sf).filter(F.col("type") == "QUERY")
    return ddl.classify_ddl(statements).select("file", "pos", "sql", "ddl_type", "destructive")


@query
def ddl_targets(spark, sf):
    statements = feed.raw_log(spark, sf).filter(F.col("type") == "QUERY")
    return ddl.resolve_ddl_table(statements, feed.catalog(spark)).select("file", "pos", "database_name", "table_name")


def _schema_changes(spark, sf):
    return ddl.schema_change_events(feed.raw_log(spark, sf), feed.catalog(spark))


@query
def schema_changes(spark, sf):
    return _schema_changes(spark, sf).select(
        "event_id", "connector", "database_name", "table_name", "ddl_type", "raw_sql", "next_position", "ts_ms"
    )


@query
def schema_state(spark, sf):
    return ddl.schema_state(_schema_changes(spark, sf))


@query
def schema_state_after_runs(spark, sf):
    return ddl.schema_state(feed.routed_ddl(spark, sf), feed.routed_status_log(spark, sf))


@query
def rebuild_tasks(spark, sf):
    return ddl.intake_ddl(_schema_changes(spark, sf)).select(
        "task_id", "database_name", "table_name", "file", "next_position", "status",
        F.col("retry_count").cast("bigint").alias("retry_count"),
    )


def _routed_transactions(spark, sf):
    return feed.transactions_of(feed.routed_messages(spark, sf))


def _routed_states(spark, sf):
    return ddl.schema_state(feed.routed_ddl(spark, sf), feed.routed_status_log(spark, sf))


@query
def touched_tables(spark, sf):
    return ddl.touched_tables(_routed_transactions(spark, sf)).select(
        "transaction_id", F.array_join("touched", ",").alias("touched")
    )


@query
def blocking_versions(spark, sf):
    blocked = ddl.blocking_versions(_routed_transactions(spark, sf), _routed_states(spark, sf))
    return blocked.withColumn("blocking_tables", F.array_join("blocking_tables", ","))


@query
def routed_transactions(spark, sf):
    done = feed.done_ids(spark, sf)
    routed = ddl.route(_routed_transactions(spark, sf), _routed_states(spark, sf), done)
    return routed.select("transaction_id", "route", "blocked_file", "blocked_position")


def _routed_in_order(spark, sf):
    done = feed.done_ids(spark, sf)
    none = ddl.schema_state(feed.routed_ddl(spark, sf).filter("false"))
    return ddl.route_in_order(_routed_transactions(spark, sf), feed.routed_ddl(spark, sf), none, done)


@query
def routed_in_order(spark, sf):
    """Schema changes interleaved with transactions: each blocks only what arrives after it."""
    return _routed_in_order(spark, sf).select("transaction_id", "route", "blocked_file", "blocked_position")


@query
def pending_transactions(spark, sf):
    rows = ddl.pending_rows(_routed_in_order(spark, sf))
    return rows.select(
        "transaction_id", "file", "next_position", "blocked_file", "blocked_position", "status",
        F.array_join("blocked_tables", ",").alias("blocked_tables"),
        F.array_join("blocking_tables", ",").alias("blocking_tables"),
    )


# --- rebuild ----------------------------------------------------------------------------------------


def _routed_tasks(spark, sf):
    return ddl.intake_ddl(feed.routed_ddl(spark, sf))


@query
def replay_candidates(spark, sf):
    pending = ddl.pending_rows(_routed_in_order(spark, sf))
    return rebuild.replay_candidates(pending, _routed_tasks(spark, sf)).select("task_id", "transaction_id")


@query
def replay_superseded(spark, sf):
    """Candidates that earlier changes of the same table blocked are included."""
    pending = ddl.pending_rows(_routed_in_order(spark, sf))
    tasks = rebuild.mark_obsolete(_routed_tasks(spark, sf), _all_blocked(spark, sf)).filter("current")
    return rebuild.replay_candidates(pending, tasks, exact=False).select("task_id", "transaction_id")


def _all_blocked(spark, sf):
    return ddl.schema_state(feed.routed_ddl(spark, sf))


@query
def replayed_view(spark, sf):
    """Latest state after the buffered transactions of every third table were replayed."""
    # Read by the fold, the candidates and what holds them back: decided once.
    routed = materialize(_routed_in_order(spark, sf), "routed")
    applied = envelope.explode_rows(routed.filter(F.col("route") == "APPLIED"))
    pending = ddl.pending_rows(routed)
    published = feed.routed_status_log(spark, sf).select("database_name", "table_name").distinct()
    candidates = rebuild.replay_candidates(
        pending, rebuild.mark_obsolete(_routed_tasks(spark, sf), _all_blocked(spark, sf)).filter("current"), exact=False
    )
    chosen = rebuild.replayable(candidates, _all_blocked(spark, sf), published)
    again = chosen.select("transaction_id", "fragment", F.col("payload").alias("value")).distinct()
    replay = envelope.explode_rows(
        feed.transactions_of(again.withColumns({"key": F.col("transaction_id"), "arrival": F.lit(0).cast("bigint")}))
    )
    return fold.fold_latest(applied.unionByName(replay))


@query
def obsolete_tasks(spark, sf):
    marked = rebuild.mark_obsolete(feed.rebuild_tasks(spark, sf), feed.task_states(spark, sf))
    return marked.select("task_id", "status", "current")


@query
def runnable_tasks(spark, sf):
    tasks = rebuild.runnable_tasks(feed.rebuild_tasks(spark, sf), feed.task_states(spark, sf))
    return tasks.select("task_id", "table_name", "next_position")


@query
def next_pending_task(spark, sf):
    return rebuild.next_pending(feed.rebuild_tasks(spark, sf)).select(
        "task_id", "status", utc_wall(F.col("created_at")).alias("created_at")
    )


@query
def rebuild_outcomes(spark, sf):
    outcome = rebuild.rebuild_outcomes(feed.rebuild_tasks(spark, sf), feed.rebuild_attempts(spark, sf))
    return outcome.select(
        "task_id", "status", F.col("retry_count").cast("bigint").alias("retry_count"), "last_error", "table_status"
    )


@query
def stale_tasks(spark, sf):
    """Recovery as of the newest update of any task."""
    tasks = feed.rebuild_tasks(spark, sf)
    now = tasks.agg(F.max("updated_at")).scalar()
    recovered = rebuild.recover_stale(tasks.withColumn("_now", now), F.col("_now"), 86_400)
    return recovered.select(
        "task_id", "status", F.col("retry_count").cast("bigint").alias("retry_count"), "last_error"
    )


@query
def replay_order(spark, sf):
    """The place of every buffered transaction in the replay order."""
    pending = ddl.pending_rows(_routed_in_order(spark, sf))
    ranked = snapshot.with_rank(pending.drop("payload"), rebuild.REPLAY_ORDER)
    return ranked.select("transaction_id", "file", "next_position", "row_rank")


def customer_spec(spark, sf, table="customer"):
    """Every column of the customer table, under the name of a configured table."""
    return TableSpec.of(feed.DATABASE, table, feed.read(spark, sf, "customer"), ["c_custkey"])


def orders_spec(spark, sf):
    """Every column of the orders table."""
    return TableSpec.of(feed.DATABASE, "orders", feed.read(spark, sf, "orders"), ["o_orderkey"])


REBUILD = {"task_id": "shop.user:mysql-bin.000003:700", "file": "mysql-bin.000003", "next_position": 700}


def _staged(spark, sf):
    return rebuild.staged_rows(feed.read(spark, sf, "customer"), customer_spec(spark, sf, "user"), REBUILD, page_size=50)


@query
def rebuilt_table(spark, sf):
    return _staged(spark, sf)


@query
def published_view(spark, sf):
    """One table of the view replaced by its rebuilt rows."""
    view = fold.fold_latest(feed.changes(spark, sf))
    return rebuild.replace_table(view, _staged(spark, sf), customer_spec(spark, sf, "user"))


@query
def published_view_with_tombstones(spark, sf):
    view = fold.fold_latest(feed.changes(spark, sf))
    return rebuild.replace_table(view, _staged(spark, sf), customer_spec(spark, sf, "user"), keep_tombstones=True)


# --- sources ---------------------------------------------------------------------------------------


@query
def table_catalogue(spark, sf):
    """Ordered columns and keys of tables, as the session sees them, with what the rows say about the keys."""
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "conversations": ["conv_id", "turn"]}
    specs = [TableSpec.of(feed.DATABASE, t, feed.read(spark, sf, t), pk) for t, pk in keys.items()]
    read = [
        feed.read(spark, sf, t).agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*pk).alias("n_keys"),
        )
        for t, pk in keys.items()
    ]
    rows = read[0].unionByName(read[1]).unionByName(read[2])
    return load_catalog(spark, specs).join(rows, "table_name").select(
        "n_rows", "n_keys", "database_name", "table_name", F.array_join("columns", ",").alias("columns"),
        F.array_join("primary_keys", ",").alias("primary_keys"), F.col("table_order").cast("bigint").alias("table_order"),
    )


def _whole_orders(spark, sf):
    """Every column of the orders table, as its catalogue entry lists them."""
    return read_table(spark, orders_spec(spark, sf), f"{sf}/orders.parquet")


def _with_date_text(orders):
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def table_snapshot(spark, sf):
    """All columns of one table, the date as text."""
    return _with_date_text(_whole_orders(spark, sf))


@query
def change_log_round_trip(spark, sf):
    """The raw log written as files and read with its fixed schema."""
    path = scratch_path(spark, "log")
    feed.raw_log(spark, sf).write.parquet(path)
    return read_change_log(spark, path).select("file", "pos", "type", "table_id")


@query
def message_round_trip(spark, sf):
    """Messages written to a topic folder and read back."""
    path = scratch_path(spark, "topic")
    write_envelopes(feed.as_messages(feed.changes(spark, sf)), path)
    return read_envelopes(spark, path).select("arrival", "key", "value")


# --- snapshot ---------------------------------------------------------------------------------------


@query
def keyset_page_single(spark, sf):
    return _with_date_text(snapshot.keyset_page(_whole_orders(spark, sf), ["o_orderkey"], {"o_orderkey": 321}, 500))


@query
def keyset_page_composite(spark, sf):
    turns = feed.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return snapshot.keyset_page(turns, ["conv_id", "turn"], {"conv_id": 3, "turn": 1}, 50)


@query
def paginate_orders(spark, sf):
    return _with_date_text(snapshot.paginate(_whole_orders(spark, sf), ["o_orderkey"], 500))


@query
def paginate_composite(spark, sf):
    paged = snapshot.paginate(feed.read(spark, sf, "conversations"), ["conv_id", "turn"], 50)
    return paged.select("conv_id", "turn", "role", "text", "page_index", "row_index", "has_more")


@query
def snapshot_pages(spark, sf):
    turns = feed.read(spark, sf, "conversations").select("conv_id", "turn", "role")
    return snapshot.pages(snapshot.paginate(turns, ["conv_id", "turn"], 50), ["conv_id", "turn"])


@query
def snapshot_transactions(spark, sf):
    paged = snapshot.paginate(feed.read(spark, sf, "customer"), ["c_custkey"], 500)
    txns = snapshot.snapshot_transactions(paged, customer_spec(spark, sf), feed.CUTOVER, 500)
    rows = F.transform("events", lambda e: F.concat_ws("|", e["event_index"], e["op"], e["primary_key_json"], e["after"]))
    return txns.select(
        "transaction_id", "xid", "next_position", F.size("events").cast("bigint").alias("n_events"),
        F.array_join(rows, "\n").alias("events_text"),
    )


def snapshot_tables(spark, sf):
    """Two whole tables in their configured order."""
    return [
        snapshot.SnapshotTable(customer_spec(spark, sf), feed.read(spark, sf, "customer")),
        snapshot.SnapshotTable(orders_spec(spark, sf), feed.read(spark, sf, "orders")),
    ]


def _bootstrap(spark, sf):
    return snapshot.bootstrap(snapshot_tables(spark, sf), feed.CUTOVER, 500)


def _progress(spark, sf):
    _, page_rows = _bootstrap(spark, sf)
    catalog = load_catalog(spark, [customer_spec(spark, sf), orders_spec(spark, sf)])
    return snapshot.full_sync_progress(catalog, page_rows, feed.CUTOVER)


@query
def bootstrap_rows(spark, sf):
    rows, _ = _bootstrap(spark, sf)
    return rows.select(
        F.col("table_order").cast("bigint").alias("table_order"), "transaction_id", "event_index", "op", "table_name",
        "row_key", "after",
    )


@query
def full_sync_progress(spark, sf):
    return _progress(spark, sf).select(
        "connector", "database_name", "table_name", "status", "cutover_file", "cutover_position", "last_sent_pk",
        "n_pages", "n_rows",
    )


@query
def bootstrap_checkpoint(spark, sf):
    return snapshot.bootstrap_checkpoint(_progress(spark, sf))


@query
def snapshot_plus_incremental(spark, sf):
    """Customers as the snapshot of the user table, later changes of the feed on top."""
    paged = snapshot.paginate(feed.read(spark, sf, "customer"), ["c_custkey"], 500)
    rows = snapshot.snapshot_rows(paged, customer_spec(spark, sf, "user"), feed.CUTOVER).withColumns(
        {"arrival": F.lit(-1).cast("bigint"), "list_pos": F.col("event_index")}
    )
    return fold.bootstrap_view(rows, feed.changes(spark, sf))


# --- control tables and operations -------------------------------------------------------------------


@query
def control_upsert(spark, sf):
    """Checkpoint-like rows per user: the first half stored, the second half upserted."""
    half = feed.half(spark, sf)
    rows = feed.changes(spark, sf).select(
        F.col("row_key").alias("connector"), "file", "file_seq", F.col("next_position").alias("position"), "event_id"
    )
    newest = F.max_by(F.struct("file", "file_seq", "position", "event_id"), "event_id")
    stored = rows.filter(F.col("event_id") < half).groupBy("connector").agg(newest.alias("p")).select("connector", "p.*")
    return control.upsert(stored, rows.filter(F.col("event_id") >= half), ["connector"], ["event_id"])


@query
def control_append_once(spark, sf):
    """Pending rows added twice: repeats of a stored id change nothing."""
    rows = feed.changes(spark, sf).select("transaction_id", "event_id", "op")
    half = feed.half(spark, sf)
    first = F.min_by(F.struct("event_id", "op"), "event_id")
    stored = rows.filter(F.col("event_id") < half).groupBy("transaction_id").agg(first.alias("p"))
    return control.append_once(stored.select("transaction_id", "p.*"), rows, ["transaction_id"], ["event_id"])


@query
def rebuild_summary(spark, sf):
    return ops.rebuild_summary(feed.rebuild_tasks(spark, sf))


@query
def rebuild_gauges(spark, sf):
    return ops.rebuild_gauges(feed.rebuild_tasks(spark, sf))


@query
def pipeline_metrics(spark, sf):
    return ops.pipeline_metrics(feed.outcomes(spark, sf))


@query
def rebuild_durations(spark, sf):
    return ops.rebuild_durations(feed.rebuild_attempts(spark, sf))


@query
def recent_tasks(spark, sf):
    return ops.recent_tasks(feed.rebuild_tasks(spark, sf)).select(
        "task_id", "status", utc_wall(F.col("updated_at")).alias("updated_at")
    )


@query
def recent_failed_tasks(spark, sf):
    return ops.recent_tasks(feed.rebuild_tasks(spark, sf), "FAILED").select(
        "task_id", "status", utc_wall(F.col("updated_at")).alias("updated_at")
    )


@query
def recent_events(spark, sf):
    return ops.recent_events(feed.outcomes(spark, sf)).select(
        utc_wall(F.col("ts")).alias("ts"), "event_type", "database_name", "table_name", "reference", "result"
    )


@query
def recent_full_sync(spark, sf):
    """One progress row per user, started at its first event."""
    e = feed.events(spark, sf)
    rows = e.groupBy(F.col("user_id").cast("string").alias("table_name")).agg(F.max("ts").alias("started_at"))
    rows = rows.select(F.lit(feed.DATABASE).alias("database_name"), "table_name", "started_at")
    return ops.recent_full_sync(rows).withColumn("started_at", utc_wall(F.col("started_at")))


@query
def connector_status(spark, sf):
    connectors = spark.createDataFrame([(feed.CONNECTOR,), ("fresh",)], "connector string")
    return ops.connector_status(
        connectors, _stored_checkpoint(spark, sf), feed.rebuild_tasks(spark, sf), "SNAPSHOT_THEN_INCREMENTAL"
    )


@query
def overview_states(spark, sf):
    """The schema-state part of the status page."""
    parts = ops.overview(
        _stored_checkpoint(spark, sf),
        spark.createDataFrame([], S.FULL_SYNC_TASK),
        feed.rebuild_tasks(spark, sf),
        _routed_states(spark, sf),
        feed.outcomes(spark, sf),
    )
    return parts["schema_states"].select("database_name", "table_name", "status", "ddl_type", "next_position")
