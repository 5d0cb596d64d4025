"""Message stream to synced state: decode, validate, route, fold, commit."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import DataStreamWriter

from rowtide import schemas as S
from rowtide.functions.versions import file_seq
from rowtide.operators import ddl, envelope, fold, partitions as parts
from rowtide.session import materialize, scratch_scope
from rowtide.sources.store import Batch, ChangeStore, ConflictError

WRITER = "apply"
# A batch is begun again this often when a rebuild was published while it ran.
CONFLICT_ATTEMPTS = 5
HELD = ["arrival", "key", "fragment", "value"]


class PoisonMessageError(ValueError):
    """A message that cannot be parsed; trying again cannot help."""


class RejectedTransactionError(ValueError):
    """A transaction that cannot be applied."""


def apply_batch(
    store: ChangeStore,
    messages: DataFrame,
    batch_id: int | str,
    on_poison: str = "fail",
    on_reject: str = "fail",
    scope: str = "DATABASE_TABLE",
    partitions: list[int] | None = None,
    release: bool = False,
) -> None:
    """Apply one batch of messages; a batch applied before changes nothing.

    ``partitions`` lists the partitions of a topic that has several, each in log order. Messages are then applied in
    the order of the log: what lies beyond the place that all of them have reached waits in the store, so that
    batches lead to the state one partition would have led to, however the partitions advance. ``release`` applies
    what waits without looking at the partitions (``release_waiting``).

    ``fail`` stops at an unreadable message or a rejected transaction, nothing of the batch being
    committed; ``quarantine`` stores those messages with the reason and goes on. Parts of a transaction
    wait in the store until the last one has come; then it is judged and applied as a whole.
    """
    for policy in (on_poison, on_reject):
        if policy not in ("fail", "quarantine"):
            raise ValueError(f"unknown failure policy: {policy}")
    for left in reversed(range(CONFLICT_ATTEMPTS)):
        batch = store.begin(WRITER, str(batch_id))
        if batch is None:
            return
        try:
            with scratch_scope(store.spark):
                view = _apply(store, batch, messages, on_poison, on_reject, scope, partitions, release)
                store.commit(batch, view)
            return
        except ConflictError:
            store.discard(batch)
            if not left:
                raise


def _apply(
    store: ChangeStore, batch: Batch, messages: DataFrame, on_poison: str, on_reject: str, scope: str,
    partitions: list[int] | None, release: bool,
) -> DataFrame:
    """Write what a batch leads to, all but the view, whose folded changes are returned."""
    before = batch.base
    columns = HELD
    waiting = store.read("held", only=store.latest(WRITER))
    if partitions:
        waiting = waiting.withColumn("partition", F.lit(None).cast("int"))
        columns = [*columns, "partition"]
    arrived = messages.select(*columns).unionByName(waiting.select(*columns))
    # Parsing is the costly part; the parsed batch is written once and read by column below.
    parsed = envelope.parse_messages(arrived, scope)
    parsed = materialize(parts.with_place(parsed) if partitions else parsed, "parsed")
    held = None
    if partitions:
        # One row a partition of the topic.
        frontier = materialize(parts.frontiers(parsed, store.read("frontiers", only=store.latest(WRITER))), "frontier")
        store.write("frontiers", batch, frontier)
        parsed, held = parts.split_ahead(parsed, None if release else parts.reached(frontier, partitions))
    good, poison = envelope.split_poison(parsed)
    holds = _contents(parsed)
    # What a batch does not hold is known to be empty, so nothing is read for it again.
    poison = poison.filter(F.lit(holds.n_poison > 0))
    if on_poison == "fail" and holds.n_poison:
        first = poison.select("arrival", "reason").first()
        raise PoisonMessageError(f"message {first.arrival} cannot be parsed: {first.reason}")
    changes, transactions, _ = envelope.split_messages(good)
    changes = changes.filter(F.lit(holds.n_ddl > 0))
    done = store.done((holds.low, holds.high) if holds.low is not None else (0, -1), before)
    if holds.n_parts:
        transactions, incomplete = envelope.split_incomplete(transactions)
        # A late copy of one part of an applied transaction waits for nothing.
        open_parts, _ = fold.drop_done(fold.dedupe_transactions(incomplete), done)
        open_parts = open_parts.withColumn("key", F.col("transaction_id")).select(*HELD)
        held = held.select(*HELD).unionByName(open_parts) if partitions else open_parts
    if held is not None:
        store.write("held", batch, held)
    if holds.n_bad:
        valid, rejected = envelope.validate_transactions(transactions)
    else:
        valid = transactions.drop("problem")
        rejected = valid.withColumn("reason", F.lit("")).filter("false")
    if on_reject == "fail" and holds.n_bad:
        first = rejected.select("transaction_id", "reason").limit(1).collect()
        if first:
            raise RejectedTransactionError(f"transaction {first[0].transaction_id} rejected: {first[0].reason}")
    if "quarantine" in (on_poison, on_reject):
        bad = poison.select("arrival", "key", "value", "reason").unionByName(
            rejected.select("arrival", F.col("transaction_id").alias("key"), "value", "reason")
        )
        store.write("quarantine", batch, bad)

    if partitions:
        valid, changes = parts.in_log_order(valid), parts.in_log_order(changes)
    first_seen = fold.dedupe_transactions(valid)
    states = store.schema_states(before)
    has_ddl = holds.n_ddl > 0
    if has_ddl or states.filter(F.col("status") != "ACTIVE").limit(1).count():
        routed = ddl.route_batch(first_seen, changes, states, done)
        known = store.read("pending", before).select("transaction_id", "fragment")
        held = ddl.pending_rows(routed).join(known, ["transaction_id", "fragment"], "left_anti")
        store.write("pending", batch, held)
    else:
        routed = ddl.route_unblocked(first_seen, done)
    if has_ddl:
        store.write("schema_changes", batch, changes)
        tasks = store.read("tasks", before).select("task_id")
        new = ddl.intake_ddl(changes).dropDuplicates(["task_id"]).join(tasks, "task_id", "left_anti")
        store.write("tasks", batch, new)
    applied = routed.filter(F.col("route") == "APPLIED")
    rows = envelope.explode_rows(applied)
    if partitions:
        # All parts of a transaction share one place; the index of a row runs through them.
        rows = rows.withColumn("list_pos", F.col("event_index"))
    store.write("done", batch, applied.select("transaction_id", "file_seq").distinct())
    store.write("outcomes", batch, _outcomes(routed, rejected, changes))
    folded = fold.fold_latest(rows) if store.mode == "meta" else fold.fold_arrival(rows)
    # A merge reads the changes twice; the first ones of a store are written as they are.
    return materialize(folded, "folded") if store.has_view() else folded


def _contents(parsed: DataFrame) -> Row:
    """What a batch holds, by one pass over single columns of its parsed messages."""
    number = file_seq(F.col("transaction.binlogFilename"))
    good = F.col("reason").isNull()
    of = lambda kind: good & (F.col("kind") == kind)
    transaction = of("TRANSACTION")
    return parsed.agg(
        F.count_if(~good).alias("n_poison"),
        F.count_if(of("SCHEMA_CHANGE")).alias("n_ddl"),
        F.count_if(transaction & F.col("problem").isNotNull()).alias("n_bad"),
        F.count_if(transaction & (F.col("transaction.fragments") > 1)).alias("n_parts"),
        F.min(F.when(transaction, number)).alias("low"),
        F.max(F.when(transaction, number)).alias("high"),
    ).first()


def _outcomes(routed: DataFrame, rejected: DataFrame, changes: DataFrame) -> DataFrame:
    first = F.col("events")[0]
    result = F.when(F.col("route") == "APPLIED", "SUCCESS").otherwise(F.col("route"))
    said = F.when(F.col("route") == "APPLIED", "applied").when(F.col("route") == "BUFFERED", "blocked by rebuild")

    def rows(df, event_type, reference, result, message):
        return df.select(
            F.current_timestamp().alias("ts"), F.col("arrival").alias("seq"), F.lit(event_type).alias("event_type"),
            *([first["database"].alias("database_name"), first["table"].alias("table_name")]
              if "events" in df.columns else ["database_name", "table_name"]),
            F.col(reference).alias("reference"), result.alias("result"), message.alias("message"),
            F.lit(None).cast("bigint").alias("n_rows"),
        )

    whole = F.col("fragment") == 0
    return (
        rows(routed.filter(whole), "DML_TX", "transaction_id", result, said)
        .unionByName(rows(rejected.filter(whole), "DML_TX", "transaction_id", F.lit("FAILED"), F.col("reason")))
        .unionByName(rows(changes, "DDL", "event_id", F.lit("TRIGGERED_REBUILD"), F.col("ddl_type")))
    )


# Fixed value: Spark's state store on RocksDB, which keeps state off the heap.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drop_repeats(message_stream: DataFrame, horizon: str, arrived: Column | None = None) -> DataFrame:
    """The stream without messages delivered again within ``horizon`` of their first arrival.

    The state holds one entry a message of the last ``horizon`` only. ``arrived`` is the time a message arrived (the
    broker's timestamp), the time of its batch by default; never the time inside the message, since rows behind a
    watermark would be dropped. Messages are the same when key, part and text are; those without a key are all
    kept. What comes back after the horizon meets the done set, so results do not depend on it.
    """
    message_stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    identity = F.struct(
        F.coalesce("key", F.concat(F.lit("#"), F.col("partition"), F.lit(":"), F.col("arrival"))), "fragment", F.xxhash64("value")
    )
    timed = message_stream.withColumns({"_arrived": arrived if arrived is not None else F.current_timestamp(), "_message": identity})
    return timed.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["_message"]).drop("_arrived", "_message")


def release_waiting(store: ChangeStore, name: str, partitions: list[int], **policy) -> None:
    """Apply the messages that wait for other partitions: a partition is idle for good, or the feed has ended.

    ``name`` is the name of this batch. A message that still comes from before them is applied late, as a repeat is.
    """
    nothing = store.spark.createDataFrame([], S.MESSAGES)
    apply_batch(store, nothing, f"release-{name}", partitions=partitions, release=True, **policy)


def apply_stream(message_stream: DataFrame, store: ChangeStore, **policy) -> DataStreamWriter:
    """A stream writer that applies every micro-batch; start it with a trigger and a checkpoint.

    Spark moves the stream's own checkpoint after the batch function returns, so a message counts
    as read only once the state it leads to is committed.
    """
    return message_stream.writeStream.foreachBatch(
        lambda batch, batch_id: apply_batch(store, batch, batch_id, **policy)
    )


def run_sync(
    message_stream: DataFrame,
    store: ChangeStore,
    checkpoint: str,
    max_attempts: int = 4,
    backoff_seconds: float = 1.0,
    horizon: str | None = None,
    **policy,
) -> int:
    """Apply everything available, retrying failed batches; returns the attempts used.

    With ``horizon`` repeats inside it are dropped before a batch is parsed (``drop_repeats``).

    Unreadable messages stop the run at once. Anything else is tried ``max_attempts`` times in
    total, then the failure is raised with the failed batch still unread.
    """
    if horizon:
        message_stream = drop_repeats(message_stream, horizon)
    attempts = max(1, max_attempts)
    for attempt in range(1, attempts + 1):
        writer = apply_stream(message_stream, store, **policy).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return attempt
        except StreamingQueryException as failure:
            if PoisonMessageError.__name__ in str(failure) or attempt == attempts:
                raise
            time.sleep(max(0.0, backoff_seconds))
    raise AssertionError("unreachable")
