"""Schemas of the change log, the message envelope and the control tables, as DDL text."""

from __future__ import annotations

# One entry of the raw log. ``pos`` is the position after the event, ``seq`` breaks ties.
# ``database_name``/``table_name`` are filled on TABLE_MAP, ``database_name`` also on QUERY.
ROWS = "array<struct<before:array<string>, after:array<string>>>"
RAW = f"""connector string, file string, pos bigint, seq bigint, type string, table_id bigint,
       database_name string, table_name string,
       rows {ROWS},
       xid bigint, sql string, ts_ms bigint"""

# JSON message: row images stay JSON text, the key map keeps the order it was written in.
ENVELOPE_JSON = (
    "messageType string, "
    "transaction struct<transactionId:string, connectorName:string, binlogFilename:string, xid:bigint, "
    "nextPosition:bigint, timestamp:bigint, fragment:int, fragments:int, events:array<struct<database:string, `table`:string, "
    "eventIndex:int, eventType:string, primaryKey:map<string,string>, before:string, after:string>>>, "
    "schemaChange struct<eventId:string, connectorName:string, database:string, `table`:string, "
    "ddlType:string, rawSql:string, binlogFilename:string, nextPosition:bigint, timestamp:bigint>"
)

# Messages in arrival order. ``fragment`` numbers the parts of an oversized transaction.
MESSAGES = "topic string, partition int, arrival bigint, key string, fragment int, value string"

# Newest change per key: the business value plus the version that guards it.
VIEW = """database_name string, table_name string, row_key string, deleted boolean, payload string,
       file string, file_seq bigint, next_position bigint, event_index bigint, transaction_id string"""
VIEW_COLUMNS = [c.split()[0] for c in VIEW.split(",")]

CHECKPOINT = "connector string, file string, file_seq bigint, position bigint"

SCHEMA_CHANGE = """event_id string, connector string, database_name string, table_name string, ddl_type string,
       raw_sql string, file string, file_seq bigint, next_position bigint, ts_ms bigint"""

SCHEMA_STATE = """database_name string, table_name string, status string, file string, file_seq bigint,
       next_position bigint, ddl_type string, ddl_sql string"""

REBUILD_TASK = """task_id string, database_name string, table_name string, file string, file_seq bigint,
       next_position bigint, status string, retry_count int, last_error string,
       created_at timestamp, updated_at timestamp"""

PENDING = """transaction_id string, fragment int, connector string, file string, file_seq bigint,
       next_position bigint, payload string, blocked_tables array<string>,
       blocking_tables array<string>, blocked_file string, blocked_file_seq bigint,
       blocked_position bigint, status string"""

FULL_SYNC_TASK = """connector string, database_name string, table_name string, status string, cutover_file string,
       cutover_position bigint, last_sent_pk string, started_at timestamp, finished_at timestamp,
       last_error string"""

OUTCOME = """ts timestamp, seq bigint, event_type string, database_name string, table_name string,
       reference string, result string, message string, n_rows bigint"""

# Columns a table has from a log position on.
LAYOUT = """database_name string, table_name string, file_seq bigint, position bigint, columns array<string>,
       primary_keys array<string>, bare array<string>, ddl_sql string"""

# Statuses and event kinds shared with existing deployments; the key prefixes are own defaults.
WRITE_OPS = ("INSERT", "UPDATE", "SNAPSHOT_UPSERT")
DELETE_OP = "DELETE"
INTERNAL_PROGRESS_TABLES = ("cdc_offset", "full_sync_task", "schema_state", "rebuild_task", "pending_tx")
REBUILD_STATUSES = ("PENDING", "RUNNING", "DONE", "FAILED", "OBSOLETE")
DESTRUCTIVE_DDL = ("DROP_COLUMN", "RENAME_COLUMN", "MODIFY_COLUMN")
KEY_PREFIX = "cdc:"
META_PREFIX = "row:meta:"
DONE_PREFIX = "txn:done:"
STALE_TASK_ERROR = "Recovered stale RUNNING task for retry."
PUBLISH_PAGE_ERROR = "Failed to publish snapshot page."
