"""A change feed derived from the ``events`` table, for queries, tests and benchmarks.

Everything is a function of whole tables: four events make a transaction, 500 transactions a log
file. ``raw_log`` gives the same activity as raw log entries, with unlisted and internal tables,
missing table maps, short and long rows, and schema changes mixed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide import schemas as S
from rowtide.functions.values import json_string, utc_instant
from rowtide.operators.assemble import assemble_transactions
from rowtide.operators.ddl import schema_change_events
from rowtide.operators.envelope import (
    encode_schema_changes,
    encode_transactions,
    parse_messages,
    split_messages,
    split_poison,
)
from rowtide.operators.snapshot import Cutover
from rowtide.session import materialize
from rowtide.sources.catalog import TableSpec, load_catalog

CONNECTOR = "shop-sync"
DATABASE = "shop"
USER = TableSpec(DATABASE, "user", ("id", "cents", "props", "kind"), ("id",), ("id", "cents"))
ORDER = TableSpec(DATABASE, "order", ("id", "cents", "kind", "props"), ("id",), ("id", "cents"))
TABLES = [USER, ORDER]
ROWS_PER_TXN = 4
TXNS_PER_FILE = 500
CUTOVER = Cutover(CONNECTOR, "mysql-bin.000002", 25_000)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    return load_catalog(spark, TABLES)


# A column of ``user`` is dropped at one position of the first file and another added at a later one.
LAYOUT_STATEMENTS = [
    (10_000, "ALTER TABLE `user` DROP COLUMN props"),
    (20_000, "ALTER TABLE shop.user ADD COLUMN city varchar(10) NOT NULL DEFAULT 'a, b' AFTER kind, ADD KEY (city, kind)"),
]


# At least six digits; string functions, because a formatter is parsed again for every row.
FILE_NAME = "concat('mysql-bin.', lpad(string(file_seq), greatest(6, length(string(file_seq))), '0'))"


def file_name() -> Column:
    """Log file name of a ``file_seq`` column."""
    return F.expr(FILE_NAME)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their transaction number, log coordinate and target table."""
    numbered = read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS wall", "user_id", "event_type", "props",
        "cast(round(value * 100) AS bigint) AS cents",
        f"event_id DIV {ROWS_PER_TXN} AS xid",
        f"event_id % {ROWS_PER_TXN} AS event_index",
    )
    return numbered.withColumn("ts", utc_instant("wall")).selectExpr(
        "*",
        f"1 + xid DIV {TXNS_PER_FILE} AS file_seq",
        f"(xid % {TXNS_PER_FILE} + 1) * 100 AS next_position",
        "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op",
        "CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'order' END AS table_name",
        "unix_millis(ts) AS ts_ms",
    )


def after_json() -> Column:
    """Row image of an event: id, cents, props, kind."""
    return F.concat(
        F.lit('{"id":'), F.col("user_id").cast("string"), F.lit(',"cents":'), F.col("cents").cast("string"),
        F.lit(',"props":'), json_string(F.col("props")), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row changes in arrival order, one per event."""
    e = events(spark, sf_dir).withColumn("file", file_name())
    image = after_json()
    is_write = F.col("op") != "DELETE"
    row_key = F.col("user_id").cast("string")
    return e.select(
        F.lit(CONNECTOR).alias("connector"),
        "file",
        "file_seq",
        "xid",
        "next_position",
        "ts_ms",
        F.concat_ws(":", F.lit(CONNECTOR), "file", "xid", "next_position").alias("transaction_id"),
        "event_index",
        F.lit(DATABASE).alias("database_name"),
        "table_name",
        "op",
        F.create_map(F.lit("id"), row_key).alias("primary_key"),
        row_key.alias("row_key"),
        F.when(~is_write, image).alias("before"),
        F.when(is_write, image).alias("after"),
        F.concat(F.lit('{"id":'), row_key, F.lit("}")).alias("primary_key_json"),
        F.col("xid").alias("arrival"),
        F.col("event_index").alias("list_pos"),
        "event_id",
    )


def half(spark: SparkSession, sf_dir: str) -> int:
    """Event id that splits the table in half, from the column statistics of one aggregate."""
    return (read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1) // 2


def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed followed by its first half again under the same transaction ids."""
    feed = changes(spark, sf_dir)
    again = feed.filter(F.col("event_id") < half(spark, sf_dir))
    return feed.unionByName(again.withColumn("arrival", F.col("arrival") + 1_000_000_000))


def stale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed followed by its first half again under new transaction ids: late, older rows."""
    return changes(spark, sf_dir).unionByName(late_changes(spark, sf_dir))


def late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late rows of ``stale_changes`` alone."""
    return changes(spark, sf_dir).filter(F.col("event_id") < half(spark, sf_dir)).withColumns(
        {
            "arrival": F.col("arrival") + 1_000_000_000,
            "transaction_id": F.concat("transaction_id", F.lit(":late")),
            "after": F.replace(F.col("after"), F.lit('"cents":'), F.lit('"cents":9')),
        }
    )


# Events whose entries include a schema change.
HAS_STATEMENT = "event_id % 997 = 0"


def raw_log(spark: SparkSession, sf_dir: str, of: str = "true") -> DataFrame:
    """The activity as raw log entries, of the events that ``of`` holds for.

    Clicks go to tables nobody configured, one of them an internal progress table. Only two events
    in three announce their table, table ids swap meaning from file to file, some ids are never
    announced, and some transactions are closed by the next commit only.
    """
    e = events(spark, sf_dir).filter(of).selectExpr(
        "*",
        f"{FILE_NAME} AS file",
        f"(xid % {TXNS_PER_FILE}) * 100 AS start",
        """CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'cdc_offset'
                WHEN event_type = 'click' THEN 'audit_log' ELSE table_name END AS target""",
        """CASE WHEN event_id % 101 = 0 THEN 99 WHEN event_type = 'click' AND user_id % 3 = 0 THEN 21
                WHEN event_type = 'click' THEN 20 ELSE 10 + (user_id + file_seq) % 2 END AS table_id""",
        "CASE WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 5 ELSE 4 END AS width",
        "CASE WHEN op = 'UPDATE' AND event_id % 499 = 3 THEN 1 ELSE 0 END AS key_shift",
    )

    def values(id_: str, cents: str) -> str:
        return f"slice(array(string({id_}), string({cents}), props, event_type, 'beyond the columns'), 1, width)"

    def row(offset: int) -> str:
        before = values(f"user_id + {offset} + key_shift", "cents - 1")
        after = values(f"user_id + {offset}", "cents")
        return f"""named_struct('before', CASE WHEN op <> 'INSERT' THEN {before} END,
                                'after', CASE WHEN op <> 'DELETE' THEN {after} END)"""

    def entry(pos: str, kind: str, **given: str) -> str:
        columns = {"table_id": "bigint", "database_name": "string", "table_name": "string", "rows": S.ROWS,
                   "xid": "bigint", "sql": "string"}
        rest = ", ".join(f"'{c}', cast({given.get(c, 'NULL')} AS {t})" for c, t in columns.items())
        return f"named_struct('pos', cast({pos} AS bigint), 'type', {kind}, {rest})"

    database = f"'{DATABASE}'"
    statements = ", ".join(f"'{s}'" for s in DDL_STATEMENTS)
    statement = f"element_at(array({statements}), cast((event_id DIV 997) % {len(DDL_STATEMENTS)} + 1 AS int))"
    rows = f"CASE WHEN event_id % 10 = 0 THEN array({row(0)}, {row(100_000)}) ELSE array({row(0)}) END"
    ddl = entry("start + 1 + event_index", "'QUERY'", database_name=database, sql=statement)
    begin = entry("start + 5", "'QUERY'", database_name=database, sql="'BEGIN'")
    announce = entry(
        "start + 10 + event_index * 20", "'TABLE_MAP'", table_id="table_id", database_name=database, table_name="target"
    )
    change = entry(
        "start + 20 + event_index * 20", "CASE op WHEN 'INSERT' THEN 'WRITE' ELSE op END", table_id="table_id", rows=rows
    )
    commit = entry("start + 100", "'XID'", xid="xid")
    entries = f"""array(
        CASE WHEN {HAS_STATEMENT} THEN {ddl} END,
        CASE WHEN event_index = 0 THEN {begin} END,
        CASE WHEN event_id % 3 <> 0 AND event_id % 101 <> 0 THEN {announce} END,
        {change},
        CASE WHEN event_index = {ROWS_PER_TXN - 1} AND xid % 251 <> 250 THEN {commit} END)"""
    exploded = e.selectExpr("file", "ts_ms", f"explode({entries}) AS x").filter("x IS NOT NULL")
    return exploded.selectExpr(
        f"'{CONNECTOR}' AS connector",
        "file", "x.pos", "0L AS seq", "x.type", "x.table_id", "x.database_name", "x.table_name", "x.rows", "x.xid", "x.sql",
        "ts_ms",
    )


def altered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log with statements that change columns its rows have; those of ``raw_log`` name columns no table has."""
    rows = [(CONNECTOR, "mysql-bin.000001", pos, 1, "QUERY", DATABASE, sql) for pos, sql in LAYOUT_STATEMENTS]
    added = spark.createDataFrame(
        rows, "connector string, file string, pos bigint, seq bigint, type string, database_name string, sql string"
    )
    return raw_log(spark, sf_dir).unionByName(added, allowMissingColumns=True)


# One statement per schema change, kind and spelling in turn.
DDL_STATEMENTS = (
    "ALTER TABLE `user` DROP COLUMN age",
    "alter table shop.order rename column amount to total",
    "ALTER TABLE `shop`.`USER` MODIFY COLUMN name varchar(99)",
    "ALTER TABLE user ADD COLUMN city varchar(10)",
    "ALTER TABLE user DROP age",
    "ALTER TABLE audit_log DROP COLUMN x",
    "\n\tALTER TABLE user DROP COLUMN zip\n",
)


def flawed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with some rows no store may apply."""
    e = F.col("event_id")
    return changes(spark, sf_dir).withColumns(
        {
            "op": F.when(e % 211 == 5, "UNKNOWN").otherwise(F.col("op")),
            "after": F.when(e % 223 == 6, F.lit(None)).otherwise(F.col("after")),
            "primary_key_json": F.when(e % 227 == 7, F.lit("{}")).otherwise(F.col("primary_key_json")),
            "database_name": F.when(e % 229 == 8, F.lit(" ")).otherwise(F.col("database_name")),
        }
    )


def as_messages(rows: DataFrame, max_events: int = 10_000) -> DataFrame:
    """Encoded transactions in the order of their numbers; odd arrivals are left for other messages."""
    encoded = encode_transactions(assemble_transactions(rows, max_events), keep=("xid",))
    return message_columns(encoded.withColumn("arrival", F.col("xid") * 2))


def message_columns(encoded: DataFrame) -> DataFrame:
    """Encoded messages as rows of one topic."""
    return encoded.select(
        F.lit("changes").alias("topic"), F.lit(0).alias("partition"), "arrival", "key", "fragment", "value"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flawed feed as messages, with unreadable and empty ones and schema changes mixed in."""
    good = as_messages(flawed_changes(spark, sf_dir))
    xid = F.expr("arrival DIV 2")
    empty = F.lit('{"messageType":"TRANSACTION","transaction":{"transactionId":"none","events":[]}}')
    value = (
        F.when(xid % 50 == 7, F.lit(None).cast("string"))
        .when(xid % 50 == 8, F.lit("\n null "))
        .when(xid % 50 == 9, F.substring("value", 1, 40))
        .when(xid % 100 == 10, F.lit(""))
        .when(xid % 100 == 60, F.lit("\n\t"))
        .when(xid % 60 == 11, empty)
        .when(xid % 60 == 12, F.lit('{"other":1}'))
        .otherwise(F.col("value"))
    )
    ddl = schema_change_events(raw_log(spark, sf_dir, HAS_STATEMENT), catalog(spark))
    before_xid = (F.col("file_seq") - 1) * TXNS_PER_FILE + F.expr("next_position DIV 100")
    ddl_messages = encode_schema_changes(ddl.withColumn("arrival", before_xid * 2 - 1), keep=("arrival",))
    return good.withColumn("value", value).unionByName(message_columns(ddl_messages))


def repeated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, then every third one delivered again."""
    once = as_messages(changes(spark, sf_dir))
    again = once.filter(F.expr("arrival DIV 2") % 3 == 0).withColumn("arrival", F.col("arrival") + 1_000_000_000)
    return once.unionByName(again)


def transactions_of(message_rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Decoded transactions of a message set, parsed once: later steps read single columns of them.

    Where ``columns`` are given, they alone are written.
    """
    if columns:
        return materialize(split_messages(split_poison(parse_messages(message_rows))[0])[1].select(*columns), "parsed")
    good, _ = split_poison(materialize(parse_messages(message_rows), "parsed"))
    return split_messages(good)[1]


# Room between the arrivals of two transactions for one schema change per event of the later one.
ROUTED_STEP = 8
# One schema change in about this many is destructive, by the cents of its event.
DESTRUCTIVE_EVERY = 97


def routed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed spread over many tables: one per user."""
    return changes(spark, sf_dir).withColumn("table_name", F.concat(F.lit("t"), "row_key"))


def routed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread feed as messages, with room for the schema changes."""
    return as_messages(routed_changes(spark, sf_dir)).withColumn("arrival", F.expr(f"arrival DIV 2 * {ROUTED_STEP}"))


def routed_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema changes of those tables: one for every signup, just before the transaction of its event."""
    e = events(spark, sf_dir).filter(F.col("event_type") == "signup")
    destructive = F.col("cents") % DESTRUCTIVE_EVERY == 0
    file = file_name()
    position = (F.col("xid") % TXNS_PER_FILE) * 100 + 1 + F.col("event_index")
    return e.select(
        (F.col("xid") * ROUTED_STEP - 4 + F.col("event_index")).alias("arrival"),
        F.concat_ws(":", F.lit("ddl"), file, position).alias("event_id"),
        F.lit(CONNECTOR).alias("connector"),
        F.lit(DATABASE).alias("database_name"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name"),
        F.when(destructive, "DROP_COLUMN").otherwise("ADD_COLUMN").alias("ddl_type"),
        F.lit("ALTER TABLE").alias("raw_sql"),
        file.alias("file"),
        "file_seq",
        position.alias("next_position"),
        "ts_ms",
    )


PARTITIONS = [0, 1, 2, 3]


def partitioned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed feed in a topic of four partitions, by key.

    Each partition is in log order and counts offsets of its own, the later partitions more slowly through the log:
    offsets repeat between partitions, and slices of offsets find them at different places.
    """
    ddl = encode_schema_changes(routed_ddl(spark, sf_dir), keep=("arrival",))
    rows = routed_messages(spark, sf_dir).unionByName(message_columns(ddl))
    partition = F.pmod(F.xxhash64("key"), F.lit(len(PARTITIONS))).cast("int")
    return rows.withColumn("partition", partition).withColumn("arrival", F.col("arrival") * (F.col("partition") + 1))


def routed_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rebuilds: the tables whose number is a multiple of three."""
    return (
        routed_ddl(spark, sf_dir)
        .filter(F.substring("table_name", 2, 10).cast("int") % 3 == 0)
        .select("database_name", "table_name", "file_seq", "next_position", F.lit("ACTIVE").alias("status"),
                F.lit(1).cast("bigint").alias("seq"))
    )


def done_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of already applied transactions: the first half of the feed."""
    applied = changes(spark, sf_dir).filter(F.col("event_id") < half(spark, sf_dir))
    return applied.select("transaction_id").distinct()


def rebuild_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task table: one task per event, a table per user, statuses in turn."""
    e = events(spark, sf_dir)
    status = F.element_at(F.array(*[F.lit(s) for s in S.REBUILD_STATUSES]), (F.col("event_id") % 5 + 1).cast("int"))
    table = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    file = file_name()
    position = F.col("next_position") + F.col("event_index")
    return e.select(
        F.concat(F.lit(f"{DATABASE}."), table, F.lit(":"), F.concat_ws(":", file, position)).alias("task_id"),
        F.lit(DATABASE).alias("database_name"),
        table.alias("table_name"),
        file.alias("file"),
        "file_seq",
        position.alias("next_position"),
        status.alias("status"),
        (F.col("event_id") % 3).cast("int").alias("retry_count"),
        F.when(F.col("event_id") % 5 == 3, "earlier failure").alias("last_error"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 600)).alias("updated_at"),
    )


def rebuild_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs of tasks: up to three failures, then a success for some."""
    tasks = rebuild_tasks(spark, sf_dir).withColumn("_n", F.col("next_position") % 4)
    runs = tasks.select("task_id", "_n", "created_at", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int"))).alias("seq"))
    succeeded = (F.col("seq") == F.col("_n")) & (F.unix_micros("created_at") % 7 < 3)
    kept = runs.filter((F.col("seq") < F.col("_n")) | succeeded)
    started = F.col("created_at") + F.make_dt_interval(mins=F.col("seq"))
    return kept.select(
        "task_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.when(~succeeded, F.concat(F.lit("run "), F.col("seq").cast("string"), F.lit(" failed"))).alias("error"),
        started.alias("started_at"),
        (started + F.make_dt_interval(secs=F.col("_n") * 7 + 1)).alias("finished_at"),
    )


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest coordinate per task table."""
    tasks = rebuild_tasks(spark, sf_dir)
    newest = F.max_by(F.struct("file", "file_seq", "next_position"), F.struct("file_seq", "next_position"))
    return tasks.groupBy("database_name", "table_name").agg(newest.alias("p")).select(
        "database_name", "table_name", F.lit("REBUILD_REQUIRED").alias("status"), "p.*"
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome log: one entry per event."""
    e = events(spark, sf_dir)
    five = F.col("event_id") % 5
    kind = F.col("event_type")
    event_type = (
        F.when(kind == "signup", "SNAPSHOT_ROW")
        .when((kind == "error") & five.isin(0, 1, 2), "REBUILD")
        .when((kind == "error") & (five == 4), "CHECKPOINT")
        .otherwise("DML_TX")
    )
    result = (
        F.when(kind.isin("signup", "click"), "PUBLISHED")
        .when(kind == "view", "SUCCESS")
        .when((kind == "purchase") & (five == 0), "DUPLICATE")
        .when(kind == "purchase", "BUFFERED")
        .when(five == 0, "STARTED")
        .when(five == 1, "SUCCESS")
        .when(five == 4, "SAVED")
        .otherwise("FAILED")
    )
    return e.select(
        "ts",
        F.col("event_id").alias("seq"),
        event_type.alias("event_type"),
        F.lit(DATABASE).alias("database_name"),
        "table_name",
        F.concat(F.lit("ref:"), F.col("event_id").cast("string")).alias("reference"),
        result.alias("result"),
        F.lit(None).cast("string").alias("message"),
        (F.col("event_id") % 50).alias("n_rows"),
    )
