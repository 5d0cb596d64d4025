"""JSON messages: encoding, decoding, splitting, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide import schemas as S
from rowtide.functions.values import is_blank, json_with
from rowtide.functions.versions import file_seq, key_text
from rowtide.session import lookup_join

# The key under which a malformed message comes back from the JSON reader.
_CORRUPT = "_malformed"


def _event_json(event: Column) -> Column:
    plain = F.struct(
        event["database_name"].alias("database"),
        event["table_name"].alias("table"),
        event["event_index"].alias("eventIndex"),
        event["op"].alias("eventType"),
    )
    images = {"primaryKey": event["primary_key_json"], "before": event["before"], "after": event["after"]}
    return json_with(plain, images)


def encode_transactions(transactions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed JSON messages, one per transaction (or per fragment of an oversized one).

    ``keep`` names further columns to carry along.
    """
    header = F.struct(
        F.col("transaction_id").alias("transactionId"),
        F.col("connector").alias("connectorName"),
        F.col("file").alias("binlogFilename"),
        "xid",
        F.col("next_position").alias("nextPosition"),
        F.col("ts_ms").alias("timestamp"),
    )
    events = F.concat(F.lit("["), F.array_join(F.transform("events", _event_json), ","), F.lit("]"))
    kind = F.struct(F.lit("TRANSACTION").alias("messageType"))
    # A part of a cut transaction says which one it is and how many there are.
    part = {"events": events, "fragment": F.col("fragment").cast("string"), "fragments": F.col("fragments").cast("string")}
    body = F.when(F.col("fragments") > 1, json_with(header, part)).otherwise(json_with(header, {"events": events}))
    value = json_with(kind, {"transaction": body, "schemaChange": F.lit("null")})
    return transactions.select(
        *keep,
        F.col("transaction_id").alias("key"),
        F.col("fragment").cast("int").alias("fragment"),
        value.alias("value"),
    )


def encode_schema_changes(changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed JSON messages of schema changes."""
    payload = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("connector").alias("connectorName"),
        F.col("database_name").alias("database"),
        F.col("table_name").alias("table"),
        F.col("ddl_type").alias("ddlType"),
        F.col("raw_sql").alias("rawSql"),
        F.col("file").alias("binlogFilename"),
        F.col("next_position").alias("nextPosition"),
        F.col("ts_ms").alias("timestamp"),
    )
    message = F.struct(
        F.lit("SCHEMA_CHANGE").alias("messageType"), F.lit(None).cast("string").alias("transaction"),
        payload.alias("schemaChange"),
    )
    value = F.to_json(message, {"ignoreNullFields": "false"})
    return changes.select(*keep, F.col("event_id").alias("key"), F.lit(0).alias("fragment"), value.alias("value"))


def encode_envelopes(transactions: DataFrame, schema_changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All messages of a feed: key, fragment, JSON value."""
    return encode_transactions(transactions, keep).unionByName(encode_schema_changes(schema_changes, keep))


def parse_messages(messages: DataFrame, scope: str = "DATABASE_TABLE") -> DataFrame:
    """Messages with their parsed content, a ``reason`` when they cannot be parsed, the ``problem``
    of the first row that cannot be applied, their ``kind`` and the ``digest`` of their text.

    Kind and digest spare later steps the rows and the text of every message.

    The reasons are ``NULL_PAYLOAD``, ``JSON_NULL`` and ``MALFORMED``; none of them goes away by
    trying again. In ``TABLE`` scope a row needs no database.
    """
    parsed = F.from_json(
        "value", f"{S.ENVELOPE_JSON}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"}
    )
    reason = (
        F.when(F.col("value").isNull(), F.lit("NULL_PAYLOAD"))
        .when(is_blank(F.col("value"), "null"), F.lit("JSON_NULL"))
        .when(
            is_blank(F.col("value")) | F.col("_envelope").isNull() | F.col(f"_envelope.{_CORRUPT}").isNotNull(), F.lit("MALFORMED")
        )
    )
    content = messages.withColumn("_envelope", parsed).select(
        *messages.columns,
        F.col("_envelope.messageType").alias("message_type"),
        F.col("_envelope.transaction").alias("transaction"),
        F.col("_envelope.schemaChange").alias("schema_change"),
        reason.alias("reason"),
        F.when(is_blank(F.coalesce("_envelope.transaction.transactionId", F.lit(""))), F.lit("transactionId"))
        .otherwise(first_problem(F.col("_envelope.transaction.events"), scope))
        .alias("problem"),
        F.xxhash64("value").alias("digest"),
    )
    return content.withColumn("kind", message_kind())


def decode_envelopes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed messages, and the ones that cannot be parsed with the reason why."""
    return split_poison(parse_messages(messages))


def split_poison(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(F.col("reason").isNull()).drop("reason")
    poison = parsed.filter(F.col("reason").isNotNull()).drop("message_type", "transaction", "schema_change", "problem", "kind", "digest")
    return good, poison


def _is_schema_change() -> Column:
    return F.coalesce(F.col("message_type") == "SCHEMA_CHANGE", F.lit(False))


def _is_empty() -> Column:
    return F.coalesce(F.size("transaction.events"), F.lit(0)) <= 0


def message_kind() -> Column:
    """Which part of ``split_messages`` a parsed message belongs to."""
    kind = F.when(_is_schema_change(), F.lit("SCHEMA_CHANGE")).when(_is_empty(), F.lit("EMPTY"))
    return kind.otherwise(F.lit("TRANSACTION"))


def split_messages(good: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schema changes, transactions with rows, and messages with nothing to apply."""
    ddl = good.filter("kind = 'SCHEMA_CHANGE'").select(
        "arrival",
        F.col("schema_change.eventId").alias("event_id"),
        F.col("schema_change.connectorName").alias("connector"),
        F.col("schema_change.database").alias("database_name"),
        F.col("schema_change.table").alias("table_name"),
        F.col("schema_change.ddlType").alias("ddl_type"),
        F.col("schema_change.rawSql").alias("raw_sql"),
        F.col("schema_change.binlogFilename").alias("file"),
        file_seq(F.col("schema_change.binlogFilename")).alias("file_seq"),
        F.col("schema_change.nextPosition").alias("next_position"),
        F.col("schema_change.timestamp").alias("ts_ms"),
    )
    transactions = good.filter("kind = 'TRANSACTION'").select(
        "arrival",
        F.coalesce("transaction.fragment", "fragment", F.lit(0)).alias("fragment"),
        F.coalesce("transaction.fragments", F.lit(1)).alias("fragments"),
        "value",
        F.col("transaction.transactionId").alias("transaction_id"),
        F.col("transaction.connectorName").alias("connector"),
        F.col("transaction.binlogFilename").alias("file"),
        file_seq(F.col("transaction.binlogFilename")).alias("file_seq"),
        F.col("transaction.xid").alias("xid"),
        F.col("transaction.nextPosition").alias("next_position"),
        F.col("transaction.timestamp").alias("ts_ms"),
        F.col("transaction.events").alias("events"),
        "problem",
        "digest",
    )
    empty = good.filter("kind = 'EMPTY'").select("arrival", "key")
    return ddl, transactions, empty


def row_problem(event: Column, scope: str = "DATABASE_TABLE") -> Column:
    """Why a row cannot be applied, null when it can."""
    blank = lambda c: F.coalesce(is_blank(c), F.lit(True))
    nameless = blank(event["table"]) if scope == "TABLE" else blank(event["database"]) | blank(event["table"])
    op = event["eventType"]
    return (
        F.when(F.coalesce(F.size(event["primaryKey"]), F.lit(0)) <= 0, F.lit("primaryKey"))
        .when(op.isNull() | ~op.isin(*S.WRITE_OPS, S.DELETE_OP), F.lit("eventType"))
        .when((op != S.DELETE_OP) & event["after"].isNull(), F.lit("after"))
        .when(nameless, F.lit("identity"))
    )


def first_problem(events: Column, scope: str = "DATABASE_TABLE") -> Column:
    """Problem of the first bad row of a message."""
    problems = F.transform(events, lambda event: row_problem(event, scope))
    return F.try_element_at(F.filter(problems, lambda r: r.isNotNull()), F.lit(1))


def validate_transactions(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages whose transaction is valid, and those of transactions rejected as a whole.

    One bad row rejects every part of its transaction. Only ids of bad transactions travel to the
    messages; while they are few the messages stay where they are.
    """
    bad = (
        transactions.filter(F.col("problem").isNotNull())
        .groupBy("transaction_id")
        .agg(F.min_by("problem", F.struct("fragment", "arrival")).alias("reason"))
    )
    judged = lookup_join(transactions.withColumnRenamed("problem", "_own"), bad, ["transaction_id"])
    # A missing id meets no other message, so such a message is judged by itself.
    own = F.when(F.col("transaction_id").isNull(), F.col("_own"))
    judged = judged.withColumn("reason", F.coalesce("reason", own)).drop("_own")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def split_incomplete(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of transactions that are all there, and the parts of those that are not yet.

    Only cut transactions are counted; their ids alone travel to the messages.
    """
    missing = (
        transactions.filter("fragments > 1")
        .groupBy("transaction_id")
        .agg(F.count_distinct("fragment").alias("_there"), F.max("fragments").alias("_all"))
        .filter("_there < _all")
        .select("transaction_id", F.lit(True).alias("_missing"))
    )
    judged = lookup_join(transactions, missing, ["transaction_id"])
    return judged.filter("_missing IS NULL").drop("_missing"), judged.filter("_missing").drop("_missing")


def explode_rows(transactions: DataFrame) -> DataFrame:
    """One row per change, with message order and position in the (whole) list."""
    header = ["arrival", "fragment", "transaction_id", "connector", "file", "file_seq", "xid", "next_position", "ts_ms"]
    rows = transactions.select(*header, F.posexplode("events").alias("_pos", "e"))
    return rows.select(
        *header,
        (F.shiftleft(F.col("fragment").cast("bigint"), 32) + F.col("_pos")).alias("list_pos"),
        F.col("e.database").alias("database_name"),
        F.col("e.table").alias("table_name"),
        F.col("e.eventIndex").cast("bigint").alias("event_index"),
        F.col("e.eventType").alias("op"),
        F.col("e.primaryKey").alias("primary_key"),
        key_text("e.primaryKey").alias("row_key"),
        F.col("e.before").alias("before"),
        F.col("e.after").alias("after"),
    )
