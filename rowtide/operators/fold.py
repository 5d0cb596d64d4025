"""De-duplication and latest-state folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide import schemas as S
from rowtide.functions.values import json_string
from rowtide.functions.versions import business_key, meta_key, row_version
from rowtide.session import lookup_join, materialize

KEY = ["database_name", "table_name", "row_key"]
VERSION = ["file_seq", "next_position", "event_index"]
VIEW_COLUMNS = S.VIEW_COLUMNS


def dedupe_transactions(transactions: DataFrame) -> DataFrame:
    """First arrival of every transaction id (and fragment).

    Ids are counted first; only those that occur twice are looked at further, and messages that occur once pass
    unchanged. Among equal
    arrivals (offsets of two partitions) the smaller payload hash is first, and of one message delivered
    twice at one arrival one row stays. Messages without an id are no repeats of each other; validation
    rejects them.
    """
    message = ["transaction_id", "fragment"]
    if "digest" in transactions.columns:
        payload = F.col("digest")
    else:
        payload = F.xxhash64("value" if "value" in transactions.columns else "arrival")
    place = F.struct(F.col("arrival"), payload.alias("hash"))
    counted = transactions.groupBy(*message).agg(F.count("*").alias("_n"))
    twice = materialize(counted.filter("_n > 1 AND transaction_id IS NOT NULL").select(*message), "twice")
    if twice.isEmpty():
        return transactions
    copies = lookup_join(
        transactions.select(*message, place.alias("_place")), twice, message, "left_semi", spread=[F.col("_place.arrival")]
    )
    repeated = copies.groupBy(*message).agg(F.min("_place").alias("_first"))
    judged = lookup_join(transactions, repeated, message, spread=["arrival"])
    again = judged.filter(F.col("_first").isNotNull() & (place == F.col("_first"))).dropDuplicates(message)
    return judged.filter("_first IS NULL").unionByName(again).drop("_first")


def drop_done(transactions: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions not applied yet, and the duplicates of applied ones."""
    judged = mark_done(transactions, done)
    return judged.filter(~F.col("is_done")).drop("is_done"), judged.filter("is_done").drop("is_done")


def mark_done(transactions: DataFrame, done: DataFrame) -> DataFrame:
    """Add ``is_done``. Ids meet ids; whole messages move only if very many of them are done."""
    hits = (
        transactions.select("transaction_id")
        .distinct()
        .join(done.select("transaction_id"), "transaction_id", "left_semi")
        .withColumn("is_done", F.lit(True))
    )
    return lookup_join(transactions, hits, ["transaction_id"]).fillna(False, ["is_done"])


def _view_row() -> Column:
    deleted = F.col("op") == S.DELETE_OP
    return F.struct(
        deleted.alias("deleted"),
        F.when(~deleted, F.col("after")).alias("payload"),
        *["file", "file_seq", "next_position", "event_index", "transaction_id"],
    )


def fold_latest(rows: DataFrame) -> DataFrame:
    """Newest change per key by row version; deletes stay as tombstones.

    Applying changes one by one under a strictly-newer guard leaves the highest version, the
    earliest arrival among equals. That is a plain ``max_by``, so it combines inside each task
    before the shuffle and a hot key costs no more than a cold one.
    """
    order = F.struct(row_version(*VERSION), -F.col("arrival"), -F.col("list_pos"))
    return (
        rows.groupBy(*KEY).agg(F.max_by(_view_row(), order).alias("_v")).select(*KEY, "_v.*").select(*VIEW_COLUMNS)
    )


def fold_arrival(rows: DataFrame) -> DataFrame:
    """Last write per key in arrival order, versions ignored; deleted keys are marked, not kept live."""
    order = F.struct("arrival", "list_pos")
    return (
        rows.groupBy(*KEY).agg(F.max_by(_view_row(), order).alias("_v")).select(*KEY, "_v.*").select(*VIEW_COLUMNS)
    )


def live(view: DataFrame) -> DataFrame:
    return view.filter(~F.col("deleted"))


def tombstones(view: DataFrame) -> DataFrame:
    return view.filter(F.col("deleted"))


def merge_rows(both: DataFrame, by: list[str], guarded: bool = True) -> DataFrame:
    """Fold stored (``_stored`` 1) and incoming (0) view rows, one of each a key at most.

    ``guarded``: the stored row wins unless strictly older, otherwise the incoming one wins. Grouping by
    ``by`` and the key needs no exchange when rows are partitioned by ``by``.
    """
    keys = [*by, *[k for k in KEY if k not in by]]
    order = F.struct(row_version(*VERSION), F.col("_stored")) if guarded else -F.col("_stored")
    values = F.struct(*[c for c in VIEW_COLUMNS if c not in keys])
    newest = both.groupBy(*keys).agg(F.max_by(values, order).alias("_v")).select(*keys, "_v.*")
    return newest.select(*VIEW_COLUMNS, *[c for c in by if c not in VIEW_COLUMNS])


def _both(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.select(*VIEW_COLUMNS, F.lit(1).alias("_stored")).unionByName(
        incoming.select(*VIEW_COLUMNS, F.lit(0).alias("_stored"))
    )


def merge_view(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored view with the incoming folded changes; the stored row wins unless strictly older."""
    return merge_rows(_both(stored, incoming), KEY)


def override_view(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored view with every incoming key replaced (arrival-order mode), deleted keys gone."""
    return live(override_rows(stored, incoming))


def override_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """As ``override_view``, deleted keys still marked."""
    return merge_rows(_both(stored, incoming), KEY, guarded=False)


def bootstrap_view(snapshot_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot rows (at the cutover version) and later changes in one latest-state view."""
    columns = ["arrival", "list_pos", *KEY, "op", "after", "file", *VERSION, "transaction_id"]
    return fold_latest(snapshot_rows.select(*columns).unionByName(changes.select(*columns)))


def keyed_records(view: DataFrame, scope: str = "DATABASE_TABLE") -> DataFrame:
    """The view as key/value records: business key, payload, meta key and meta JSON.

    In ``TABLE`` scope tables of one name share their keys, so the newest row of a key stays.
    """
    if scope == "TABLE":
        key = ["table_name", "row_key"]
        values = F.struct(*[c for c in VIEW_COLUMNS if c not in key])
        newest = F.max_by(values, F.struct(row_version(*VERSION), F.col("database_name")))
        view = view.groupBy(*key).agg(newest.alias("_v")).select(*key, "_v.*").select(*VIEW_COLUMNS)
    meta = F.concat(
        F.lit('{"deleted":'), F.col("deleted").cast("string"),
        F.lit(',"version":{"binlogFilename":'), json_string(F.col("file")),
        F.lit(',"nextPosition":'), F.col("next_position").cast("string"),
        F.lit(',"eventIndex":'), F.col("event_index").cast("string"),
        F.lit(',"transactionId":'), json_string(F.col("transaction_id")), F.lit("}}"),
    )
    return view.select(
        business_key("database_name", "table_name", "row_key", scope).alias("business_key"),
        F.when(~F.col("deleted"), F.col("payload")).alias("payload"),
        meta_key("database_name", "table_name", "row_key", scope).alias("meta_key"),
        meta.alias("meta"),
    )
