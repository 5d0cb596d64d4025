"""Raw log stream to messages: transactions are published once their commit has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from rowtide.functions.versions import file_seq
from rowtide.operators import assemble
from rowtide.operators.ddl import layout_history, schema_change_events
from rowtide.operators.envelope import encode_envelopes
from rowtide.operators.ordered import Blocks
from rowtide.operators.snapshot import with_rank
from rowtide.session import lookup_join, materialize, pin_small, scratch_scope
from rowtide.sources.catalog import attach_layouts
from rowtide.sources.store import Batch, ChangeStore

WRITER = "capture"


def open_tail(log: DataFrame, last_commits: DataFrame) -> DataFrame:
    """Log entries behind the last commit, and the newest table map of every table id before it."""
    last = last_commits.select("connector", F.struct("file_seq", "pos").alias("_last"))
    here = F.struct(file_seq("file").alias("file_seq"), F.col("pos"))
    joined = lookup_join(log, last, ["connector"], spread=["file", "pos", "seq"])
    is_open = F.col("_last").isNull() | (here > F.col("_last"))
    columns = log.columns
    still_open = joined.filter(is_open).select(*columns)
    others = [c for c in columns if c not in ("connector", "table_id")]
    maps = (
        joined.filter(~is_open & (F.col("type") == "TABLE_MAP"))
        .groupBy("connector", "table_id")
        .agg(F.max_by(F.struct(*others), F.struct(here, F.col("seq"))).alias("_m"))
        .select("connector", "table_id", "_m.*")
        .select(*columns)
    )
    return still_open.unionByName(maps)


def capture_batch(
    store: ChangeStore,
    batch: DataFrame,
    batch_id: int | str,
    catalog: DataFrame,
    blocks: Blocks = Blocks(),
    max_events: int = assemble.MAX_EVENTS,
    on_pk_change: str = "raise",
) -> None:
    """Publish the transactions and schema changes a batch completes, then move the checkpoint.

    Entries of transactions still open are kept with the version and lead the next batch.
    """
    attempt = store.begin(WRITER, str(batch_id))
    if attempt is None:
        return
    with scratch_scope(store.spark):
        _capture(store, attempt, batch, catalog, blocks, max_events, on_pk_change)
    store.commit(attempt)


def _capture(
    store: ChangeStore,
    attempt: Batch,
    batch: DataFrame,
    catalog: DataFrame,
    blocks: Blocks,
    max_events: int,
    on_pk_change: str,
) -> None:
    previous = store.latest(WRITER)
    columns = batch.columns
    carried = store.read("tail", only=previous).select(*columns) if previous >= 0 else batch.limit(0)
    fresh = batch.withColumn("_fresh", F.lit(True))
    log = materialize(carried.withColumn("_fresh", F.lit(False)).unionByName(fresh), "capture")
    entries = log.drop("_fresh")
    # Rows behind a schema change carry its columns: layouts follow from the statements of the log.
    fresh_log = log.filter("_fresh").drop("_fresh")
    known = store.read("layouts").drop("version")
    layouts = known.limit(0)
    if fresh_log.filter("type = 'QUERY' AND lower(sql) LIKE '%alter%'").limit(1).count():
        layouts, _ = pin_small(layout_history(fresh_log, catalog, known))
        store.write("layouts", attempt, layouts)
    if "layouts" not in catalog.columns:
        catalog = attach_layouts(catalog, known.unionByName(layouts))

    grouped = materialize(assemble.commit_groups(entries, catalog, blocks), "grouped")
    changes, _ = assemble.assemble_changes(grouped, catalog, on_pk_change)
    mutated = materialize(assemble.mutated_changes(grouped, catalog), "mutated")
    if on_pk_change == "raise":
        first_bad = mutated.select("transaction_id").limit(1).collect()
        if first_bad:
            raise ValueError(f"primary key mutation in {first_bad[0].transaction_id} is not supported")
    else:
        store.write("quarantine", attempt, _set_aside(mutated, store.first_arrival(attempt)))
    # Schema changes take effect when read, commit or not, so only new entries are looked at.
    ddl = schema_change_events(fresh_log, catalog)
    encoded = encode_envelopes(
        assemble.assemble_transactions(changes, max_events), ddl, keep=("file_seq", "next_position")
    )
    ranked = with_rank(encoded, ["file_seq", "next_position", "fragment"])
    messages = ranked.select(
        F.lit("changes").alias("topic"), F.lit(0).alias("partition"), (F.col("row_rank") + store.first_arrival(attempt)).alias("arrival"),
        "key", "fragment", "value",
    )
    store.write("messages", attempt, messages)

    commits = materialize(assemble.commits(grouped), "commits")
    moved = assemble.advance_checkpoint(commits, ddl)
    store.write("checkpoints", attempt, moved)
    last = commits.groupBy("connector").agg(
        F.max(F.struct(file_seq("file").alias("file_seq"), F.col("next_position").alias("pos"))).alias("_p")
    ).select("connector", "_p.*")
    store.write("tail", attempt, open_tail(entries, last))
    bad = mutated.groupBy(F.col("transaction_id").alias("reference")).agg(F.count("*").alias("_bad"))
    reference = assemble.transaction_id("connector", "file", "xid", "next_position")
    counted = lookup_join(commits.filter("n_rows > 0").withColumn("reference", reference), bad, ["reference"])
    published = F.col("n_rows") - F.coalesce("_bad", F.lit(0))
    outcomes = counted.filter(published > 0).select(
        F.lit("DML_TX").alias("event_type"),
        "reference",
        F.lit("PUBLISHED").alias("result"),
        published.alias("n_rows"),
        F.col("commit_group").alias("seq"),
        F.col("first_table.database_name").alias("database_name"),
        F.col("first_table.table_name").alias("table_name"),
    ).unionByName(
        moved.select(
            F.lit("CHECKPOINT").alias("event_type"),
            F.col("connector").alias("reference"),
            F.lit("SAVED").alias("result"),
            F.lit(0).cast("bigint").alias("n_rows"),
            F.lit((1 << 40) - 1).alias("seq"),
        ),
        allowMissingColumns=True,
    )
    said = F.lit(None).cast("string")
    store.write("outcomes", attempt, outcomes.withColumns({"ts": F.current_timestamp(), "message": said}))


def _set_aside(mutated: DataFrame, first: int) -> DataFrame:
    """Quarantine rows of key-mutating updates: both images, under the id of their transaction."""
    images = F.to_json(F.struct(*["database_name", "table_name", "event_index", "before", "after"]))
    return mutated.select(
        (F.lit(first) + F.col("event_index")).alias("arrival"),
        F.col("transaction_id").alias("key"),
        images.alias("value"),
        F.lit("PRIMARY_KEY_MUTATION").alias("reason"),
    )


def capture_stream(
    log_stream: DataFrame, store: ChangeStore, catalog: DataFrame | Callable[[], DataFrame], **options
) -> DataStreamWriter:
    """A stream writer that captures every micro-batch; start it with a trigger and a checkpoint.

    Schema changes read from the log change the columns of the rows behind them (``ddl.layout_history``); the layouts
    are kept in the store. A function as ``catalog`` is asked before each batch, and one that brings layouts
    of its own (``catalog.with_layouts``) is taken at its word.
    """

    def capture(batch: DataFrame, batch_id: int) -> None:
        known = catalog() if callable(catalog) else catalog
        capture_batch(store, batch, batch_id, known, **options)

    return log_stream.writeStream.foreachBatch(capture)

