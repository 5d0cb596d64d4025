"""Registered queries that run the streaming jobs over whole tables, slice after slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.operators.envelope import decode_envelopes, encode_schema_changes, explode_rows, split_messages
from rowtide.operators.ordered import fit_blocks
from rowtide.plans import feed
from rowtide.plans.queries import REBUILD, customer_spec, feed_files, query, snapshot_tables
from rowtide.session import scratch_path
from rowtide.sources.changelog import stream_change_log
from rowtide.sources.envelopes import read_envelopes, write_envelopes
from rowtide.sources.store import ChangeStore
from rowtide.streaming.apply import drop_repeats, release_waiting, run_sync
from rowtide.streaming.bootstrap_job import run_bootstrap
from rowtide.streaming.capture import capture_stream
from rowtide.streaming.rebuild_job import run_rebuild

SLICES = 2
# The routed feed has a table for every user.
TABLE_GROUPS = 4


def _slices(rows: DataFrame, column: str, numbers: DataFrame | None = None) -> list[DataFrame]:
    """Consecutive slices of a feed that together are the whole of it.

    ``numbers`` holds all numbers of the column where they can be had without the rows.
    """
    low, high = (rows if numbers is None else numbers).agg(F.min(column), F.max(column)).first()
    step = (high - low) // SLICES + 1
    return [
        rows.filter(F.col(column).between(low + i * step, low + (i + 1) * step - 1)) for i in range(SLICES)
    ]


def _synced(
    spark: SparkSession, slices: list[DataFrame], mode: str = "meta", table_groups: int | None = None, **policy
) -> ChangeStore:
    root = scratch_path(spark, "sync")
    store = ChangeStore(spark, f"{root}/store", mode, table_groups=table_groups).create()
    for part in slices:
        write_envelopes(part, f"{root}/topic")
        stream = read_envelopes(spark, f"{root}/topic", stream=True, max_files=1_000_000)
        run_sync(stream, store, f"{root}/checkpoint", **policy)
    return store


@query
def stream_latest_state(spark, sf):
    """The feed applied as a stream, then its first slice delivered again."""
    parts = _slices(feed.as_messages(feed.changes(spark, sf)), "arrival")
    again = parts[0].withColumn("arrival", F.col("arrival") + 1_000_000_000)
    return _synced(spark, [*parts, again]).view()


@query
def stream_fragments(spark, sf):
    """Transactions cut every two rows, their parts in different batches, the first parts delivered twice."""
    cut = feed.as_messages(feed.changes(spark, sf), max_events=2)
    apart = cut.withColumn("arrival", F.col("arrival") + F.col("fragment") * 1_000_000_000)
    parts = _slices(apart, "arrival")
    again = parts[0].withColumn("arrival", F.col("arrival") + 4_000_000_000)
    return _synced(spark, [*parts, again]).view()


@query
def stream_arrival_state(spark, sf):
    """Arrival-order mode: late messages win."""
    first = feed.as_messages(feed.changes(spark, sf))
    second = feed.as_messages(feed.late_changes(spark, sf))
    store = _synced(spark, [first, second.withColumn("arrival", F.col("arrival") + 1_000_000_000)], "simple")
    return store.view().select("database_name", "table_name", "row_key", "payload", "transaction_id")


@query
def stream_routed(spark, sf):
    """Transactions and schema changes through the stream: what became of each transaction."""
    ddl = encode_schema_changes(feed.routed_ddl(spark, sf), keep=("arrival",))
    everything = feed.routed_messages(spark, sf).unionByName(feed.message_columns(ddl))
    return _routes(_synced(spark, _slices(everything, "arrival"), table_groups=TABLE_GROUPS))


def _routes(store: ChangeStore) -> DataFrame:
    outcomes = store.outcomes().filter(F.col("event_type") == "DML_TX")
    route = F.when(F.col("result") == "SUCCESS", "APPLIED").otherwise(F.col("result"))
    return outcomes.select(F.col("reference").alias("transaction_id"), route.alias("route"))


@query
def partitioned_feed(spark, sf):
    """The same from a topic of four partitions with offsets of their own that advance unevenly: as from one partition."""
    slices = _slices(feed.partitioned_messages(spark, sf), "arrival")
    store = _synced(spark, slices, table_groups=TABLE_GROUPS, partitions=feed.PARTITIONS)
    release_waiting(store, "end", feed.PARTITIONS)
    return _routes(store)


@query
def stream_quarantine(spark, sf):
    """Unreadable messages and rejected transactions set aside by the stream."""
    parts = _slices(feed.messages(spark, sf), "arrival")
    store = _synced(spark, parts, on_poison="quarantine", on_reject="quarantine")
    return store.read("quarantine").select("arrival", "reason")


@query
def stream_dedupe_bounded(spark, sf):
    """All transactions with every third one delivered again in a later batch: repeats inside the horizon dropped."""
    root = scratch_path(spark, "dedupe")
    for part in _slices(feed.repeated_messages(spark, sf), "arrival"):
        write_envelopes(part, f"{root}/topic")
        stream = read_envelopes(spark, f"{root}/topic", stream=True, max_files=1_000_000)
        writer = drop_repeats(stream, "1 day").writeStream.format("parquet").option("path", f"{root}/once")
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return feed.transactions_of(spark.read.parquet(f"{root}/once")).select("transaction_id", "arrival")


def _captured(spark, sf, log=None, first=None, after_slice=None) -> ChangeStore:
    root = scratch_path(spark, "capture")
    store = ChangeStore(spark, f"{root}/store").create()
    if first:
        first(store)
    log = (feed.raw_log(spark, sf) if log is None else log).withColumn("_file", F.expr("bigint(substr(file, 11))"))
    options = {"blocks": fit_blocks(feed_files(spark, sf)), "on_pk_change": "quarantine"}
    numbers = feed.events(spark, sf).select(F.col("file_seq").alias("_file"))
    for part in _slices(log, "_file", numbers):
        part.drop("_file").write.mode("append").parquet(f"{root}/log")
        stream = stream_change_log(spark, f"{root}/log", max_files=1_000_000)
        writer = capture_stream(stream, store, feed.catalog(spark), **options)
        run = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        if after_slice:
            after_slice(store)
    return store


def _apply_messages(store: ChangeStore) -> None:
    stream = read_envelopes(store.spark, f"{store.root}/messages", stream=True, max_files=1_000_000)
    run_sync(stream, store, f"{store.root}-applied", on_reject="quarantine", horizon="1 day")


@query
def stream_end_to_end(spark, sf):
    """Capture and apply in turn on one store, the raw log without schema changes: the state of every key."""
    log = feed.raw_log(spark, sf).filter("type <> 'QUERY' OR sql = 'BEGIN'")
    view = _captured(spark, sf, log, after_slice=_apply_messages).view()
    return view.select("table_name", "row_key", "deleted", "file_seq", "next_position", "event_index", "transaction_id")


@query
def operations_overview(spark, sf):
    """All parts of the status page, from a store on which snapshot, capture and apply ran."""
    tables = snapshot_tables(spark, sf)
    store = _captured(spark, sf, first=lambda store: run_bootstrap(store, tables, feed.CUTOVER, 500))
    _apply_messages(store)
    parts = store.overview()
    text = lambda *names: F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    shown = {
        "checkpoint": (F.col("connector"), text("file", "position")),
        "full_sync_tasks": (F.col("table_name"), text("status", "last_sent_pk", "last_error")),
        "rebuild_summary": (F.lit("tasks"), text("pending", "running", "done", "failed", "obsolete")),
        "schema_states": (F.col("table_name"), text("status", "ddl_type", "next_position")),
        "recent_events": (F.lit("events"), F.col("event_type").isNotNull().cast("string")),
    }
    rows = None
    for name, (item, detail) in shown.items():
        part = parts[name].select(F.lit(name).alias("part"), item.alias("item"), detail.alias("detail"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def stream_transactions(spark, sf):
    """The raw log captured as a stream; open transactions cross from slice to slice."""
    good, _ = decode_envelopes(_captured(spark, sf).read("messages"))
    rows = explode_rows(split_messages(good)[1])
    return rows.select(
        "transaction_id", "event_index", "table_name", "op", F.element_at("primary_key", "id").alias("id")
    )


@query
def captured_quarantine(spark, sf):
    """Key-mutating updates the captured stream set aside; with the published rows they are all committed rows."""
    store = _captured(spark, sf)
    aside = store.read("quarantine").select(F.col("key").alias("transaction_id"), "reason")
    published = store.outcomes().filter("event_type = 'DML_TX'").select("reference", "n_rows")
    counted = published.select(F.col("reference").alias("transaction_id"), F.lit("PUBLISHED").alias("reason"), "n_rows")
    return aside.withColumn("n_rows", F.lit(1).cast("bigint")).unionByName(counted)


@query
def stream_checkpoint(spark, sf):
    """Resume position after the captured stream."""
    return _captured(spark, sf).checkpoints()



@query
def rebuild_run(spark, sf):
    """A destructive change on the user table before half of the feed; the table rebuilt from customers."""
    change = spark.createDataFrame(
        [(1_000_000_001, "ddl:mysql-bin.000003:700", feed.CONNECTOR, feed.DATABASE, "user", "DROP_COLUMN", "ALTER TABLE",
          REBUILD["file"], 3, REBUILD["next_position"], 1)],
        "arrival bigint, event_id string, connector string, database_name string, table_name string, ddl_type string, "
        "raw_sql string, file string, file_seq bigint, next_position bigint, ts_ms bigint",
    )
    half = feed.half(spark, sf)
    before = feed.changes(spark, sf).filter(F.col("event_id") < half)
    after = feed.as_messages(feed.changes(spark, sf).filter(F.col("event_id") >= half))
    ddl = feed.message_columns(encode_schema_changes(change, keep=("arrival",)))
    later = after.withColumn("arrival", F.col("arrival") + 2_000_000_000)
    store = _synced(spark, [feed.as_messages(before), ddl.unionByName(later)])
    run_rebuild(store, REBUILD["task_id"], customer_spec(spark, sf, "user"), feed.read(spark, sf, "customer"), page_size=50)
    return store.view()


@query
def bootstrap_run(spark, sf):
    """Snapshot job for two tables, its messages applied: the state both leave behind."""
    root = scratch_path(spark, "bootstrap")
    store = ChangeStore(spark, f"{root}/store").create()
    run_bootstrap(store, snapshot_tables(spark, sf), feed.CUTOVER, 500)
    run_sync(read_envelopes(spark, f"{store.root}/messages", stream=True, max_files=1_000_000), store, f"{root}/cp")
    return store.view().select("table_name", "row_key", "payload", "next_position", "event_index", "transaction_id")
