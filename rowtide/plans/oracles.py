"""The registered queries in ANSI SQL over the same tables, for checking results."""

from __future__ import annotations

def _json(tokens: dict[str, str]) -> str:
    """SQL of one JSON object: each column with the SQL of its token."""
    parts = [f"""'"{name}":' || coalesce({token}, 'null')""" for name, token in tokens.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _number(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def _text(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


# Whole rows as snapshot images carry them.
_CUSTOMER = _json({
    "c_custkey": _number("c_custkey"), "c_name": _text("c_name"), "c_nationkey": _number("c_nationkey"),
    "c_acctbal": _number("c_acctbal"), "c_mktsegment": _text("c_mktsegment"),
})
_ORDERS = _json({
    "o_orderkey": _number("o_orderkey"), "o_custkey": _number("o_custkey"), "o_orderstatus": _text("o_orderstatus"),
    "o_totalprice": _number("o_totalprice"),
    "o_orderdate": """'"' || replace(CAST(o_orderdate AS VARCHAR), ' ', 'T') || '"'""",
    "o_orderpriority": _text("o_orderpriority"),
})

# Common table expressions; each may use the ones before it.
_CTES = {
    "ev": """
        SELECT *, event_id // 4 AS xid, 1 + (event_id // 4) // 500 AS file_seq,
               ((event_id // 4) % 500 + 1) * 100 AS next_position, event_id % 4 AS event_index,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
               CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'order' END AS table_name,
               CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ts_ms,
               (SELECT (max(event_id) + 1) // 2 FROM events) AS half
        FROM events""",
    "ch": """
        SELECT event_id, half, 'shop-sync' AS connector, printf('mysql-bin.%06d', file_seq) AS file, file_seq, xid,
               next_position, ts_ms, event_index, 'shop' AS database_name, table_name, op,
               CAST(user_id AS VARCHAR) AS row_key, xid AS arrival, event_index AS list_pos,
               'shop-sync:' || printf('mysql-bin.%06d', file_seq) || ':' || xid || ':' || next_position AS transaction_id,
               '{"id":' || user_id || ',"cents":' || cents || ',"props":' || CAST(to_json(props) AS VARCHAR)
                   || ',"kind":"' || event_type || '"}' AS image
        FROM ev""",
    "stale": """
        SELECT * FROM ch
        UNION ALL
        SELECT * REPLACE (arrival + 1000000000 AS arrival, transaction_id || ':late' AS transaction_id,
                          replace(image, '"cents":', '"cents":9') AS image)
        FROM ch WHERE event_id < half""",
    # raw log
    "evr": """
        SELECT *, (xid % 500) * 100 AS start,
               CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'cdc_offset'
                    WHEN event_type = 'click' THEN 'audit_log' ELSE table_name END AS map_table,
               CASE WHEN event_id % 101 = 0 THEN 99 WHEN event_type = 'click' AND user_id % 3 = 0 THEN 21
                    WHEN event_type = 'click' THEN 20 ELSE 10 + (user_id + file_seq) % 2 END AS table_id
        FROM ev""",
    "log": """
        SELECT event_id, file_seq, start + 10 + event_index * 20 AS pos, 'TABLE_MAP' AS type, table_id,
               map_table, 0 AS n, xid, ts_ms FROM evr WHERE event_id % 3 <> 0 AND event_id % 101 <> 0
        UNION ALL
        SELECT event_id, file_seq, start + 20 + event_index * 20, CASE op WHEN 'INSERT' THEN 'WRITE' ELSE op END, table_id,
               NULL, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END, xid, ts_ms FROM evr
        UNION ALL
        SELECT event_id, file_seq, start + 100, 'XID', NULL, NULL, 0, xid, ts_ms
        FROM evr WHERE event_id % 4 = 3 AND xid % 251 <> 250""",
    "queries_": """
        SELECT event_id, file_seq, start + 1 + event_index AS pos,
               CASE (event_id // 997) % 7
                 WHEN 0 THEN 'ALTER TABLE `user` DROP COLUMN age'
                 WHEN 1 THEN 'alter table shop.order rename column amount to total'
                 WHEN 2 THEN 'ALTER TABLE `shop`.`USER` MODIFY COLUMN name varchar(99)'
                 WHEN 3 THEN 'ALTER TABLE user ADD COLUMN city varchar(10)'
                 WHEN 4 THEN 'ALTER TABLE user DROP age'
                 WHEN 5 THEN 'ALTER TABLE audit_log DROP COLUMN x'
                 ELSE chr(10) || chr(9) || 'ALTER TABLE user DROP COLUMN zip' || chr(10) END AS sql, ts_ms
        FROM evr WHERE event_id % 997 = 0
        UNION ALL
        SELECT event_id, file_seq, start + 5, 'BEGIN', ts_ms FROM evr WHERE event_index = 0""",
    "classified": """
        SELECT *, CASE WHEN NOT starts_with(upper(trim(sql, ' ' || chr(9) || chr(10))), 'ALTER TABLE') THEN NULL
                       WHEN contains(upper(trim(sql, ' ' || chr(9) || chr(10))), ' DROP COLUMN ') THEN 'DROP_COLUMN'
                       WHEN contains(upper(trim(sql, ' ' || chr(9) || chr(10))), ' RENAME COLUMN ') THEN 'RENAME_COLUMN'
                       WHEN contains(upper(trim(sql, ' ' || chr(9) || chr(10))), ' MODIFY COLUMN ') THEN 'MODIFY_COLUMN'
                       WHEN contains(upper(trim(sql, ' ' || chr(9) || chr(10))), ' ADD COLUMN ') THEN 'ADD_COLUMN' END AS ddl_type,
               nullif(regexp_extract(sql, '(?i)^\\s*ALTER\\s+TABLE\\s+((?:`[^`]+`|[\\w]+)(?:\\.(?:`[^`]+`|[\\w]+))?)', 1), '')
                 AS target
        FROM queries_""",
    "targets": """
        SELECT *, lower(replace(CASE WHEN contains(target, '.') THEN split_part(target, '.', 2) ELSE target END, '`', ''))
                 AS target_table
        FROM classified WHERE target IS NOT NULL""",
    "ddlev": """
        SELECT 'ddl:' || printf('mysql-bin.%06d', file_seq) || ':' || pos AS event_id, 'shop-sync' AS connector,
               'shop' AS database_name, target_table AS table_name, ddl_type, sql AS raw_sql,
               printf('mysql-bin.%06d', file_seq) AS file, file_seq, pos AS next_position, ts_ms
        FROM targets WHERE target_table IN ('user', 'order') AND ddl_type IS NOT NULL""",
    "resolved": """
        SELECT * EXCLUDE (map_table),
               CASE WHEN type IN ('WRITE', 'UPDATE', 'DELETE')
                    THEN last_value(map_table IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY file_seq, pos
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS table_name
        FROM log""",
    "logrows": """
        SELECT *, coalesce(table_name IN ('user', 'order'), false) AS configured
        FROM resolved WHERE type = 'XID' OR (type <> 'TABLE_MAP' AND table_name IS NOT NULL)""",
    "numbered": """
        SELECT *, count(*) FILTER (type = 'XID') OVER before AS commit_group,
               coalesce(sum(CASE WHEN configured THEN n ELSE 0 END) OVER before, 0) AS n_before
        FROM logrows
        WINDOW before AS (ORDER BY file_seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "grouped": """
        SELECT *, n_before - min(n_before) OVER (PARTITION BY commit_group) AS first_index,
               max(CASE WHEN type = 'XID' THEN xid END) OVER g AS commit_xid,
               max(CASE WHEN type = 'XID' THEN file_seq END) OVER g AS commit_file_seq,
               max(CASE WHEN type = 'XID' THEN pos END) OVER g AS commit_position,
               max(CASE WHEN type = 'XID' THEN ts_ms END) OVER g AS commit_ts
        FROM numbered WINDOW g AS (PARTITION BY commit_group)""",
    "imgs": """
        SELECT g.* EXCLUDE (xid), e.user_id + r.row_pos * 100000 AS id, r.row_pos, e.cents, e.props, e.event_type,
               CASE WHEN g.event_id % 13 = 0 THEN 3 ELSE 4 END AS width,
               CASE g.type WHEN 'WRITE' THEN 'INSERT' ELSE g.type END AS op,
               g.type = 'UPDATE' AND g.event_id % 499 = 3 AS moved
        FROM grouped g JOIN ev e USING (event_id)
        JOIN (SELECT unnest([0, 1]) AS row_pos) r ON r.row_pos < g.n
        WHERE g.configured""",
    "txrows": """
        SELECT *, 'shop-sync:' || printf('mysql-bin.%06d', commit_file_seq) || ':' || commit_xid || ':'
                 || commit_position AS transaction_id, first_index + row_pos AS event_index
        FROM imgs WHERE commit_xid IS NOT NULL AND NOT moved""",
    "comm": """
        SELECT commit_group, max(commit_xid) AS xid, printf('mysql-bin.%06d', max(commit_file_seq)) AS file,
               max(commit_file_seq) AS file_seq, max(commit_position) AS next_position,
               coalesce(sum(n) FILTER (configured), 0) AS n_rows,
               count(*) FILTER (type <> 'XID' AND NOT configured) AS n_ignored,
               count(*) FILTER (type <> 'XID' AND NOT configured AND table_name <> 'cdc_offset') AS n_ignored_external
        FROM grouped WHERE commit_xid IS NOT NULL GROUP BY commit_group""",
    "stored_cp": """
        SELECT 'shop-sync' AS connector, printf('mysql-bin.%06d', file_seq) AS file, file_seq,
               next_position AS position
        FROM ev WHERE event_id < half ORDER BY file_seq DESC, next_position DESC LIMIT 1""",
    # messages
    "msg": """
        SELECT *, xid * 2 AS m_arrival,
               CASE WHEN xid % 50 = 7 THEN 'NULL_PAYLOAD' WHEN xid % 50 = 8 THEN 'JSON_NULL'
                    WHEN xid % 50 IN (9, 10) THEN 'MALFORMED' END AS poison,
               xid % 60 IN (11, 12) AS is_empty,
               CASE WHEN event_id % 211 = 5 THEN 'UNKNOWN' ELSE op END AS f_op,
               CASE WHEN event_id % 223 = 6 OR op = 'DELETE' THEN NULL ELSE image END AS f_after,
               event_id % 227 = 7 AS no_key,
               CASE WHEN event_id % 229 = 8 THEN ' ' ELSE database_name END AS f_database
        FROM ch""",
    "decoded": "SELECT * FROM msg WHERE poison IS NULL AND NOT is_empty",
    "problems": """
        SELECT *, CASE WHEN no_key THEN 'primaryKey' WHEN f_op NOT IN ('INSERT', 'UPDATE', 'DELETE') THEN 'eventType'
                       WHEN f_op <> 'DELETE' AND f_after IS NULL THEN 'after'
                       WHEN trim(f_database) = '' THEN 'identity' END AS problem
        FROM decoded""",
    # routing
    "rt": "SELECT * REPLACE ('t' || row_key AS table_name) FROM ch",
    "rddl": """
        SELECT xid * 8 - 4 + event_index AS arrival, 't' || user_id AS table_name, file_seq,
               (xid % 500) * 100 + 1 + event_index AS next_position, printf('mysql-bin.%06d', file_seq) AS file,
               CASE WHEN cents % 97 = 0 THEN 'DROP_COLUMN' ELSE 'ADD_COLUMN' END AS ddl_type, ts_ms
        FROM ev WHERE event_type = 'signup'""",
    "rstate": """
        SELECT table_name,
               arg_max(file, (file_seq, next_position)) FILTER (ddl_type = 'DROP_COLUMN') AS d_file,
               arg_max(file_seq, (file_seq, next_position)) FILTER (ddl_type = 'DROP_COLUMN') AS d_seq,
               arg_max(next_position, (file_seq, next_position)) FILTER (ddl_type = 'DROP_COLUMN') AS d_pos,
               arg_max(ddl_type, (file_seq, next_position)) AS last_type,
               arg_max(file, (file_seq, next_position)) AS l_file,
               arg_max(file_seq, (file_seq, next_position)) AS l_seq,
               arg_max(next_position, (file_seq, next_position)) AS l_pos
        FROM rddl GROUP BY table_name""",
    "rstatus": """
        SELECT *, CASE WHEN d_pos IS NULL OR CAST(substr(table_name, 2) AS INT) % 3 = 0 THEN 'ACTIVE'
                       ELSE 'REBUILD_REQUIRED' END AS status FROM rstate""",
    "rblock": """
        SELECT transaction_id, string_agg(DISTINCT 'shop.' || s.table_name, ',' ORDER BY 'shop.' || s.table_name) AS blocking_tables,
               arg_max(d_file, (d_seq, d_pos)) AS blocked_file, max((d_seq, d_pos))[1] AS blocked_file_seq,
               max((d_seq, d_pos))[2] AS blocked_position
        FROM rt JOIN rstatus s USING (table_name) WHERE s.status <> 'ACTIVE' GROUP BY transaction_id""",
    "olog": """
        SELECT 'shop.' || table_name AS table_key, arrival, NULL AS transaction_id, file, file_seq, next_position
        FROM rddl WHERE ddl_type = 'DROP_COLUMN'
        UNION ALL
        SELECT DISTINCT 'shop.' || table_name, xid * 8, transaction_id, NULL, NULL, NULL FROM rt""",
    "ostate": """
        SELECT *, last_value(CASE WHEN transaction_id IS NULL THEN {'s': file_seq, 'p': next_position, 'f': file} END IGNORE NULLS)
                 OVER (PARTITION BY table_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st
        FROM olog""",
    "oblock": """
        SELECT transaction_id, string_agg(DISTINCT table_key, ',' ORDER BY table_key) AS blocking_tables,
               max(st).f AS blocked_file, max(st).s AS blocked_file_seq, max(st).p AS blocked_position
        FROM ostate WHERE transaction_id IS NOT NULL AND st IS NOT NULL GROUP BY transaction_id""",
    "otouch": """
        SELECT transaction_id, file, file_seq, next_position, string_agg(k, ',' ORDER BY i) AS touched FROM (
            SELECT transaction_id, file, file_seq, next_position, 'shop.' || table_name AS k, min(event_index) AS i
            FROM rt GROUP BY ALL) GROUP BY ALL""",
    "otask": """
        SELECT 'shop.' || table_name || ':' || file || ':' || next_position AS task_id, 'shop.' || table_name AS table_key,
               file_seq, next_position,
               row_number() OVER (PARTITION BY table_name ORDER BY file_seq DESC, next_position DESC) = 1 AS current
        FROM rddl WHERE ddl_type = 'DROP_COLUMN'""",
    # rebuild tasks
    "tk": """
        SELECT event_id, ts, 'shop.u' || user_id || ':' || printf('mysql-bin.%06d', file_seq) || ':'
                 || (next_position + event_index) AS task_id,
               'u' || user_id AS table_name, printf('mysql-bin.%06d', file_seq) AS file, file_seq,
               next_position + event_index AS next_position,
               CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' WHEN 3 THEN 'FAILED'
                                 ELSE 'OBSOLETE' END AS status,
               event_id % 3 AS retry_count, CASE WHEN event_id % 5 = 3 THEN 'earlier failure' END AS last_error,
               ts AS created_at, ts + to_seconds(event_id % 600) AS updated_at
        FROM ev""",
    "tkc": """
        SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY file_seq DESC, next_position DESC) = 1 AS current
        FROM tk""",
    "att": """
        SELECT task_id, s.seq, n, created_at, s.seq = n AND epoch_us(created_at) % 7 < 3 AS succeeded FROM (
            SELECT task_id, next_position % 4 AS n, created_at FROM tk) t
        JOIN (SELECT unnest([0, 1, 2, 3]) AS seq) s ON s.seq <= t.n
        WHERE s.seq < n OR epoch_us(created_at) % 7 < 3""",
    "outc": """
        SELECT ts, event_id,
               CASE WHEN event_type = 'signup' THEN 'SNAPSHOT_ROW'
                    WHEN event_type = 'error' AND event_id % 5 IN (0, 1, 2) THEN 'REBUILD'
                    WHEN event_type = 'error' AND event_id % 5 = 4 THEN 'CHECKPOINT' ELSE 'DML_TX' END AS kind,
               'shop' AS database_name, table_name, 'ref:' || event_id AS reference,
               CASE WHEN event_type IN ('signup', 'click') THEN 'PUBLISHED' WHEN event_type = 'view' THEN 'SUCCESS'
                    WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'DUPLICATE'
                    WHEN event_type = 'purchase' THEN 'BUFFERED' WHEN event_id % 5 = 0 THEN 'STARTED'
                    WHEN event_id % 5 = 1 THEN 'SUCCESS' WHEN event_id % 5 = 4 THEN 'SAVED' ELSE 'FAILED' END AS result,
               event_id % 50 AS n_rows
        FROM ev""",
    "staged": f"""
        SELECT 'shop' AS database_name, 'user' AS table_name, CAST(c_custkey AS VARCHAR) AS row_key, false AS deleted,
               {_CUSTOMER} AS payload,
               'mysql-bin.000003' AS file, 3 AS file_seq, 700 AS next_position, rk % 50 AS event_index,
               'rebuild:shop.user:mysql-bin.000003:700:' || (rk // 50) AS transaction_id
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rk FROM customer)""",
}

_VIEW = """database_name, table_name, row_key, deleted, payload, file, CAST(file_seq AS BIGINT) AS file_seq,
           CAST(next_position AS BIGINT) AS next_position, CAST(event_index AS BIGINT) AS event_index, transaction_id"""
_AS_VIEW = """op = 'DELETE' AS deleted, CASE WHEN op <> 'DELETE' THEN image END AS payload"""


def _with(body: str, *names: str) -> str:
    """Prefix a query with the expressions it uses, in definition order."""
    ctes = ", ".join(f"{n} AS ({_CTES[n].strip()})" for n in _CTES if n in names)
    return f"WITH {ctes} {body.strip()}" if ctes else body.strip()


def _latest(source: str, order: str) -> str:
    return f"""
        (SELECT database_name, table_name, row_key, {_AS_VIEW}, file, file_seq, next_position, event_index, transaction_id
         FROM {source} QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY {order}) = 1)"""


_BY_VERSION = "file_seq DESC, next_position DESC, event_index DESC, arrival, list_pos"
_BY_ARRIVAL = "arrival DESC, list_pos DESC"
_CH = ("ev", "ch")
_STALE = ("ev", "ch", "stale")
_LOG = ("ev", "evr", "log", "resolved", "logrows")
_GROUPED = (*_LOG, "numbered", "grouped")
_IMGS = (*_GROUPED, "imgs")
_TXROWS = (*_IMGS, "txrows")
_DDL = ("ev", "evr", "queries_", "classified")
_DDLEV = (*_DDL, "targets", "ddlev")
_MSG = ("ev", "ch", "msg")
_ROUTED = ("ev", "ch", "rt", "rddl", "rstate", "rstatus", "rblock")
_ORDERED = ("ev", "ch", "rt", "rddl", "olog", "ostate", "oblock", "otouch")
_TASKS = ("ev", "tk")
_FILE = "printf('mysql-bin.%06d', file_seq)"


def _halves(stored_order: str, late_order: str, pick: str) -> str:
    """Stored view of the first half against the fold of what came later."""
    late = "(SELECT * FROM stale WHERE event_id >= half OR arrival >= 1000000000)"
    stored = "(SELECT * FROM ch WHERE event_id < half)"
    return f"""
        SELECT * FROM (
            SELECT *, 1 AS stored FROM {_latest(stored, stored_order)}
            UNION ALL SELECT *, 0 AS stored FROM {_latest(late, late_order)})
        QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY {pick}) = 1"""


def _image_text(side: str) -> str:
    """Positional values named by the resolved table's columns, cut to the values there are."""
    cents = "cents" if side == "after" else "cents - 1"
    the_id = "id" if side == "after" else "CASE WHEN moved THEN id + 1 ELSE id END"
    present = "type <> 'DELETE'" if side == "after" else "type <> 'WRITE'"
    return f"""CASE WHEN {present} THEN
        'id=' || ({the_id}) || ';cents=' || ({cents}) ||
        CASE WHEN table_name = 'user' THEN ';props=' || props || CASE WHEN width >= 4 THEN ';kind=' || event_type ELSE '' END
             ELSE ';kind=' || props || CASE WHEN width >= 4 THEN ';props=' || event_type ELSE '' END END END"""


_SQL: dict[str, str] = {
    "latest_state_meta": _with(f"SELECT {_VIEW} FROM {_latest('ch', _BY_VERSION)}", *_CH),
    "latest_state_stale_feed": _with(f"SELECT {_VIEW} FROM {_latest('stale', _BY_VERSION)}", *_STALE),
    "latest_state_simple": _with(
        f"""SELECT database_name, table_name, row_key, payload, transaction_id
            FROM {_latest('stale', _BY_ARRIVAL)} WHERE NOT deleted""", *_STALE),
    "keyed_records": _with(
        f"""SELECT 'cdc:shop.' || table_name || ':' || row_key AS business_key, payload,
                   'row:meta:shop.' || table_name || ':' || row_key AS meta_key,
                   '{{"deleted":' || CASE WHEN deleted THEN 'true' ELSE 'false' END || ',"version":{{"binlogFilename":"' || file
                     || '","nextPosition":' || next_position || ',"eventIndex":' || event_index || ',"transactionId":"'
                     || transaction_id || '"}}}}' AS meta
            FROM {_latest('ch', _BY_VERSION)}""", *_CH),
    "keyed_records_table_scope": _with(
        f"""SELECT 'cdc:' || table_name || ':' || row_key AS business_key, payload,
                   'row:meta:' || table_name || ':' || row_key AS meta_key
            FROM {_latest('ch', _BY_VERSION)} WHERE NOT deleted""", *_CH),
    "tombstones": _with(
        f"""SELECT database_name, table_name, row_key, file, CAST(next_position AS BIGINT) AS next_position,
                   CAST(event_index AS BIGINT) AS event_index FROM {_latest('ch', _BY_VERSION)} WHERE deleted""", *_CH),
    "live_rows_per_table": _with(
        f"""SELECT database_name, table_name, count(*) FILTER (NOT deleted) AS n_live, count(*) FILTER (deleted) AS n_deleted
            FROM {_latest('ch', _BY_VERSION)} GROUP BY ALL""", *_CH),
    "row_versions": _with(
        """SELECT table_name, CASE WHEN op = 'DELETE' THEN 'DEL' ELSE 'SET' END AS action, false AS newer, count(*) AS n
           FROM ch GROUP BY ALL""", *_CH),
    "merge_stored_view": _with(
        f"SELECT {_VIEW} FROM ({_halves(_BY_VERSION, _BY_VERSION, 'file_seq DESC, next_position DESC, event_index DESC, stored DESC')})",
        *_STALE),
    "override_stored_view": _with(
        f"""SELECT database_name, table_name, row_key, payload, transaction_id
            FROM ({_halves(_BY_ARRIVAL, _BY_ARRIVAL, 'stored')}) WHERE NOT deleted""", *_STALE),
    "table_map_resolved": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, type, CAST(table_id AS BIGINT) AS table_id,
                   'shop' AS database_name, table_name FROM logrows WHERE type <> 'XID'""", *_LOG),
    "commit_groups": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, type, table_name, configured,
                   CAST(commit_group AS BIGINT) AS commit_group, CAST(first_index AS BIGINT) AS first_index,
                   CAST(commit_xid AS BIGINT) AS commit_xid, CAST(commit_position AS BIGINT) AS commit_position
            FROM grouped""", *_GROUPED),
    "event_index": _with(
        """SELECT transaction_id, CAST(event_index AS BIGINT) AS event_index, table_name, op, CAST(id AS VARCHAR) AS id
           FROM txrows""", *_TXROWS),
    "transactions": _with(
        """SELECT transaction_id, printf('mysql-bin.%06d', commit_file_seq) AS file, CAST(commit_xid AS BIGINT) AS xid,
                  CAST(commit_position AS BIGINT) AS next_position, CAST(commit_ts AS BIGINT) AS ts_ms,
                  count(*) AS n_events,
                  string_agg(event_index || ':' || op || ':' || table_name || ':{"id":' || id || '}', ',' ORDER BY event_index)
                    AS events_text
           FROM txrows GROUP BY transaction_id, commit_file_seq, commit_xid, commit_position, commit_ts""", *_TXROWS),
    "transaction_fragments": _with(
        """SELECT transaction_id, CAST(event_index // 2 AS BIGINT) AS fragment, count(*) AS n_events,
                  CAST(min(event_index) AS BIGINT) AS first_event
           FROM txrows GROUP BY transaction_id, event_index // 2""", *_TXROWS),
    "transaction_ids": _with(
        """SELECT transaction_id, count(*) AS n_rows, CAST(min(commit_ts) AS BIGINT) AS ts_ms
           FROM txrows GROUP BY transaction_id""", *_TXROWS),
    "commits": _with(
        """SELECT CAST(commit_group AS BIGINT) AS commit_group, CAST(xid AS BIGINT) AS xid, file,
                  CAST(next_position AS BIGINT) AS next_position, CAST(n_rows AS BIGINT) AS n_rows, n_ignored,
                  n_ignored_external, n_rows > 0 OR n_ignored = 0 OR n_ignored_external > 0 AS advances
           FROM comm""", *_GROUPED, "comm"),
    "connector_checkpoint": _with(
        """SELECT 'shop-sync' AS connector, file, CAST(file_seq AS BIGINT) AS file_seq,
                  CAST(next_position AS BIGINT) AS position
           FROM (SELECT file, file_seq, next_position FROM comm
                 WHERE n_rows > 0 OR n_ignored = 0 OR n_ignored_external > 0
                 UNION ALL SELECT file, file_seq, next_position FROM ddlev)
           ORDER BY file_seq DESC, next_position DESC LIMIT 1""", *_GROUPED, "comm", *_DDLEV),
    "resume_rows": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, type, CAST(table_id AS BIGINT) AS table_id
            FROM (SELECT file_seq, pos, type, table_id FROM log
                  UNION ALL SELECT file_seq, pos, 'QUERY', NULL FROM queries_)
            WHERE (file_seq, pos) > (SELECT (file_seq, position) FROM stored_cp)""",
        "ev", "evr", "log", "queries_", "stored_cp"),
    "start_position": _with(
        f"""SELECT connector, 'RESUME' AS action, file, CAST(position AS BIGINT) AS position FROM stored_cp
            UNION ALL
            SELECT 'fresh', 'SNAPSHOT', file, CAST(pos AS BIGINT) FROM (
                SELECT {_FILE} AS file, file_seq, pos FROM log
                UNION ALL SELECT {_FILE}, file_seq, pos FROM queries_ ORDER BY file_seq DESC, pos DESC LIMIT 1)""",
        "ev", "evr", "log", "queries_", "stored_cp"),
    "named_rows": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, CAST(row_pos AS BIGINT) AS row_pos, table_name,
                   {_image_text('after')} AS after_text, {_image_text('before')} AS before_text FROM imgs""", *_IMGS),
    # Of the statements in the log only two name columns that a table has or lacks.
    "table_layouts": _with(
        """SELECT 'user' AS table_name, CAST(1 AS BIGINT) AS file_seq, p AS position, c AS columns, 'id' AS primary_keys,
                  'cents,id' AS bare
           FROM (VALUES (CAST(10000 AS BIGINT), 'id,cents,kind'), (20000, 'id,cents,kind,city')) v(p, c)
           WHERE (SELECT count(*) FROM queries_ WHERE contains(lower(sql), 'column city') AND file_seq = 1 AND pos < 20000) = 0""",
        "ev", "evr", "queries_"),
    "layout_change": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, CAST(row_pos AS BIGINT) AS row_pos,
                   CASE WHEN type <> 'DELETE' THEN 'id=' || id || ';cents=' || cents ||
                     CASE WHEN file_seq > 1 OR pos >= 20000
                          THEN ';kind=' || props || CASE WHEN width >= 4 THEN ';city=' || event_type ELSE '' END
                          WHEN pos >= 10000 THEN ';kind=' || props
                          ELSE ';props=' || props || CASE WHEN width >= 4 THEN ';kind=' || event_type ELSE '' END
                     END END AS after_text,
                   type <> 'WRITE' AS has_before
            FROM imgs WHERE table_name = 'user'""", *_IMGS),
    "row_images": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, CAST(row_pos AS BIGINT) AS row_pos, op,
                   'id=' || id AS key_text, op <> 'INSERT' AS has_before, op <> 'DELETE' AS has_after FROM imgs""", *_IMGS),
    "pk_mutations": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, CAST(row_pos AS BIGINT) AS row_pos,
                   CAST(id + 1 AS VARCHAR) AS old_id, CAST(id AS VARCHAR) AS new_id FROM imgs WHERE moved""", *_IMGS),
    "normalized_values": """
        SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                              WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
                              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS ts,
               strftime(ts, '%Y-%m-%d') AS day, event_type FROM events""",
    "normalized_binary": "SELECT doc_id, to_base64(encode(text)) AS body FROM documents",
    "whitelist_rows": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, type, table_name FROM logrows WHERE configured""", *_LOG),
    "ignored_tables": _with(
        """SELECT 'shop' AS database_name, table_name, type, count(*) AS n_events FROM logrows
           WHERE type <> 'XID' AND NOT configured GROUP BY ALL""", *_LOG),
    "envelopes": _with(
        """SELECT CAST(xid * 2 AS BIGINT) AS arrival, transaction_id AS key,
                  '{"messageType":"TRANSACTION","transaction":{"transactionId":"' || transaction_id
                  || '","connectorName":"shop-sync","binlogFilename":"' || file || '","xid":' || xid
                  || ',"nextPosition":' || next_position || ',"timestamp":' || min(ts_ms) || ',"events":['
                  || string_agg('{"database":"shop","table":"' || table_name || '","eventIndex":' || event_index
                       || ',"eventType":"' || op || '","primaryKey":{"id":' || row_key || '},"before":'
                       || CASE WHEN op = 'DELETE' THEN image ELSE 'null' END || ',"after":'
                       || CASE WHEN op = 'DELETE' THEN 'null' ELSE image END || '}', ',' ORDER BY event_index)
                  || ']},"schemaChange":null}' AS value
           FROM ch GROUP BY xid, transaction_id, file, next_position""", *_CH),
    "envelope_decode": _with(
        """SELECT CAST(m_arrival AS BIGINT) AS arrival, CAST(event_index AS BIGINT) AS list_pos, transaction_id,
                  f_database AS database_name, table_name, CAST(event_index AS BIGINT) AS event_index, f_op AS op,
                  CASE WHEN no_key THEN '' ELSE row_key END AS row_key,
                  CASE WHEN op = 'DELETE' THEN image END AS before, f_after AS after FROM decoded""", *_MSG, "decoded"),
    "poison_messages": _with(
        """SELECT DISTINCT CAST(m_arrival AS BIGINT) AS arrival, transaction_id AS key, poison AS reason
           FROM msg WHERE poison IS NOT NULL""", *_MSG),
    "message_split": _with(
        """SELECT DISTINCT CAST(m_arrival AS BIGINT) AS arrival, CASE WHEN is_empty THEN 'EMPTY' ELSE 'TRANSACTION' END AS kind
           FROM msg WHERE poison IS NULL
           UNION ALL
           SELECT CAST(((file_seq - 1) * 500 + next_position // 100) * 2 - 1 AS BIGINT), 'SCHEMA_CHANGE' FROM ddlev""",
        *_MSG, *_DDLEV),
    "rejected_transactions": _with(
        """SELECT transaction_id, CAST(m_arrival AS BIGINT) AS arrival,
                  arg_min(problem, event_index) AS reason FROM problems WHERE problem IS NOT NULL
           GROUP BY transaction_id, m_arrival""", *_MSG, "decoded", "problems"),
    "valid_transactions": _with(
        """SELECT transaction_id, CAST(m_arrival AS BIGINT) AS arrival, count(*) AS n_events FROM problems
           GROUP BY transaction_id, m_arrival HAVING count(problem) = 0""", *_MSG, "decoded", "problems"),
    "dedupe_transactions": _with(
        """SELECT transaction_id, CAST(xid * 2 AS BIGINT) AS arrival, CAST(xid AS BIGINT) AS xid, count(*) AS n_events
           FROM ch GROUP BY transaction_id, xid""", *_CH),
    "done_anti_join": _with(
        """SELECT transaction_id, 'txn:done:' || transaction_id AS done_key,
                  CASE WHEN bool_or(event_id < half) THEN 'DUPLICATE' ELSE 'APPLIED' END AS outcome
           FROM ch GROUP BY transaction_id""", *_CH),
    "synced_view": _with(
        f"""SELECT {_VIEW} FROM {_latest('''(SELECT * FROM problems
                WHERE transaction_id NOT IN (SELECT transaction_id FROM problems WHERE problem IS NOT NULL)
                  AND transaction_id NOT IN (SELECT transaction_id FROM ch WHERE event_id < half))''', _BY_VERSION)}""",
        *_MSG, "decoded", "problems"),
    "ddl_classified": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, sql, ddl_type,
                   coalesce(ddl_type IN ('DROP_COLUMN', 'RENAME_COLUMN', 'MODIFY_COLUMN'), false) AS destructive
            FROM classified""", *_DDL),
    "ddl_targets": _with(
        f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, 'shop' AS database_name, target_table AS table_name
            FROM targets WHERE target_table IN ('user', 'order')""", *_DDL, "targets"),
    "schema_changes": _with(
        """SELECT event_id, connector, database_name, table_name, ddl_type, raw_sql,
                  CAST(next_position AS BIGINT) AS next_position, CAST(ts_ms AS BIGINT) AS ts_ms FROM ddlev""", *_DDLEV),
    "schema_state": _with(
        """SELECT database_name, table_name, 'REBUILD_REQUIRED' AS status, file, CAST(file_seq AS BIGINT) AS file_seq,
                  CAST(next_position AS BIGINT) AS next_position, ddl_type, raw_sql AS ddl_sql
           FROM ddlev WHERE ddl_type <> 'ADD_COLUMN'
           QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY file_seq DESC, next_position DESC) = 1
           UNION ALL
           SELECT database_name, table_name, 'ACTIVE', file, CAST(file_seq AS BIGINT), CAST(next_position AS BIGINT),
                  ddl_type, raw_sql
           FROM ddlev WHERE table_name NOT IN (SELECT table_name FROM ddlev WHERE ddl_type <> 'ADD_COLUMN')
           QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY file_seq DESC, next_position DESC) = 1""", *_DDLEV),
    "schema_state_after_runs": _with(
        """SELECT 'shop' AS database_name, table_name, status, CASE WHEN status = 'ACTIVE' THEN l_file ELSE d_file END AS file,
                  CAST(CASE WHEN status = 'ACTIVE' THEN l_seq ELSE d_seq END AS BIGINT) AS file_seq,
                  CAST(CASE WHEN status = 'ACTIVE' THEN l_pos ELSE d_pos END AS BIGINT) AS next_position,
                  CASE WHEN status = 'ACTIVE' THEN last_type ELSE 'DROP_COLUMN' END AS ddl_type, 'ALTER TABLE' AS ddl_sql
           FROM rstatus""", "ev", "rddl", "rstate", "rstatus"),
    "rebuild_tasks": _with(
        """SELECT 'shop.' || table_name || ':' || file || ':' || next_position AS task_id, database_name, table_name, file,
                  CAST(next_position AS BIGINT) AS next_position, 'PENDING' AS status, CAST(0 AS BIGINT) AS retry_count
           FROM ddlev WHERE ddl_type <> 'ADD_COLUMN'""", *_DDLEV),
    "touched_tables": _with("SELECT transaction_id, touched FROM otouch", *_ORDERED),
    "blocking_versions": _with(
        """SELECT transaction_id, blocking_tables, blocked_file, CAST(blocked_file_seq AS BIGINT) AS blocked_file_seq,
                  CAST(blocked_position AS BIGINT) AS blocked_position FROM rblock""", *_ROUTED),
    "routed_transactions": _with(
        """SELECT t.transaction_id, CASE WHEN b.transaction_id IS NOT NULL THEN 'BUFFERED' WHEN done THEN 'DUPLICATE'
                  ELSE 'APPLIED' END AS route, blocked_file, CAST(blocked_position AS BIGINT) AS blocked_position
           FROM (SELECT transaction_id, bool_or(event_id < half) AS done FROM rt GROUP BY 1) t
           LEFT JOIN rblock b USING (transaction_id)""", *_ROUTED),
    "routed_in_order": _with(
        """SELECT t.transaction_id, CASE WHEN b.transaction_id IS NOT NULL THEN 'BUFFERED' WHEN done THEN 'DUPLICATE'
                  ELSE 'APPLIED' END AS route, blocked_file, CAST(blocked_position AS BIGINT) AS blocked_position
           FROM (SELECT transaction_id, bool_or(event_id < half) AS done FROM rt GROUP BY 1) t
           LEFT JOIN oblock b USING (transaction_id)""", *_ORDERED),
    "pending_transactions": _with(
        """SELECT transaction_id, file, CAST(next_position AS BIGINT) AS next_position, blocked_file,
                  CAST(blocked_position AS BIGINT) AS blocked_position, 'PENDING' AS status, touched AS blocked_tables,
                  blocking_tables FROM otouch JOIN oblock USING (transaction_id)""", *_ORDERED),
    "replay_candidates": _with(
        """SELECT task_id, transaction_id FROM oblock b JOIN otouch USING (transaction_id)
           JOIN otask t ON t.file_seq = b.blocked_file_seq AND t.next_position = b.blocked_position
            AND list_contains(string_split(touched, ','), t.table_key)""", *_ORDERED, "otask"),
    "replay_superseded": _with(
        """SELECT task_id, transaction_id
           FROM (SELECT transaction_id, unnest(string_split(touched, ',')) AS table_key
                 FROM oblock JOIN otouch USING (transaction_id)) b JOIN otask t USING (table_key)
           WHERE t.current""", *_ORDERED, "otask"),
    "replayed_view": _with(
        f"""SELECT {_VIEW} FROM {_latest('''(SELECT rt.* FROM rt
              WHERE (event_id >= half AND transaction_id NOT IN (SELECT transaction_id FROM oblock))
                 OR transaction_id IN (
                   SELECT transaction_id FROM (
                     SELECT transaction_id, unnest(string_split(touched, ',')) AS table_key
                     FROM oblock JOIN otouch USING (transaction_id)) b JOIN otask t USING (table_key)
                   WHERE t.current AND transaction_id NOT IN (
                       SELECT transaction_id FROM rt WHERE CAST(substr(table_name, 2) AS INT) % 3 <> 0
                         AND table_name IN (SELECT table_name FROM rddl WHERE ddl_type = 'DROP_COLUMN'))))''', _BY_VERSION)}""",
        *_ORDERED, "otask"),
    "obsolete_tasks": _with(
        """SELECT task_id, CASE WHEN status IN ('PENDING', 'RUNNING') AND NOT current THEN 'OBSOLETE' ELSE status END AS status,
                  current FROM tkc""", *_TASKS, "tkc"),
    "runnable_tasks": _with(
        """SELECT task_id, table_name, CAST(next_position AS BIGINT) AS next_position FROM tkc
           WHERE current AND status = 'PENDING'""", *_TASKS, "tkc"),
    "next_pending_task": _with(
        """SELECT task_id, status, created_at FROM tk WHERE status = 'PENDING' ORDER BY created_at, task_id LIMIT 1""", *_TASKS),
    "rebuild_outcomes": _with(
        """SELECT task_id, CASE WHEN done THEN 'DONE' WHEN failures > 0 AND retry_count + failures >= 3 THEN 'FAILED'
                  WHEN failures > 0 THEN 'PENDING' ELSE status END AS status,
                  CAST(retry_count + coalesce(failures, 0) AS BIGINT) AS retry_count, coalesce(err, last_error) AS last_error,
                  CASE WHEN done THEN 'ACTIVE' WHEN failures > 0 AND retry_count + failures >= 3 THEN 'REBUILD_FAILED'
                       WHEN failures > 0 THEN 'REBUILD_REQUIRED' END AS table_status
           FROM tk LEFT JOIN (
             SELECT task_id, count(*) FILTER (NOT succeeded) AS failures, bool_or(succeeded) AS done,
                    arg_max('run ' || seq || ' failed', seq) FILTER (NOT succeeded) AS err FROM att GROUP BY task_id)
             USING (task_id)""", *_TASKS, "att"),
    "stale_tasks": _with(
        """SELECT task_id, CASE WHEN s THEN 'PENDING' ELSE status END AS status,
                  CAST(CASE WHEN s THEN retry_count + 1 ELSE retry_count END AS BIGINT) AS retry_count,
                  CASE WHEN s THEN 'Recovered stale RUNNING task for retry.' ELSE last_error END AS last_error
           FROM (SELECT *, status = 'RUNNING' AND updated_at < (SELECT max(updated_at) FROM tk) - INTERVAL 1 DAY AS s FROM tk)""",
        *_TASKS),
    "replay_order": _with(
        """SELECT transaction_id, file, CAST(next_position AS BIGINT) AS next_position,
                  row_number() OVER (ORDER BY file_seq, next_position) - 1 AS row_rank
           FROM otouch JOIN oblock USING (transaction_id)""", *_ORDERED),
    "rebuilt_table": _with(f"SELECT {_VIEW} FROM staged", "staged"),
    "published_view": _with(
        f"""SELECT {_VIEW} FROM staged UNION ALL
            SELECT {_VIEW} FROM {_latest('ch', _BY_VERSION)} WHERE table_name <> 'user'""", *_CH, "staged"),
    "published_view_with_tombstones": _with(
        f"""SELECT {_VIEW} FROM staged UNION ALL
            SELECT {_VIEW} FROM {_latest('ch', _BY_VERSION)}
            WHERE table_name <> 'user' OR (deleted AND row_key NOT IN (SELECT row_key FROM staged))""", *_CH, "staged"),
    "keyset_page_single": """
        SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate) FROM orders WHERE o_orderkey > 321 ORDER BY o_orderkey LIMIT 500""",
    "keyset_page_composite": """
        SELECT conv_id, turn, role, text FROM conversations
        WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1) ORDER BY conv_id, turn LIMIT 50""",
    "paginate_orders": """
        SELECT * EXCLUDE (rk, n) REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate), rk AS row_rank, rk // 500 AS page_index, rk % 500 AS row_index,
               (rk // 500 + 1) * 500 <= n AS has_more, rk % 500 = 499 OR rk = n - 1 AS last_in_page
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)""",
    "paginate_composite": """
        SELECT conv_id, turn, role, text, rk // 50 AS page_index, rk % 50 AS row_index, (rk // 50 + 1) * 50 <= n AS has_more
        FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rk, count(*) OVER () AS n FROM conversations)""",
    "snapshot_pages": """
        SELECT rk // 50 AS page_index, count(*) AS n_rows,
               '{"conv_id":' || arg_max(conv_id, rk) || ',"turn":' || arg_max(turn, rk) || '}' AS last_pk,
               count(*) = 50 AS has_more
        FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rk FROM conversations) GROUP BY 1""",
    "snapshot_transactions": f"""
        SELECT 'snapshot:shop-sync:shop.customer:mysql-bin.000002:25000:' || (rk // 500) AS transaction_id,
               rk // 500 AS xid, CAST(25000 AS BIGINT) AS next_position, count(*) AS n_events,
               string_agg((rk % 500) || '|SNAPSHOT_UPSERT|{{"c_custkey":' || c_custkey || '}}|' || {_CUSTOMER}, chr(10) ORDER BY rk) AS events_text
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rk FROM customer) GROUP BY rk // 500""",
    "bootstrap_rows": f"""
        SELECT CAST(0 AS BIGINT) AS table_order,
               'snapshot:shop-sync:shop.customer:mysql-bin.000002:25000:' || (rk // 500) AS transaction_id,
               rk % 500 AS event_index, 'SNAPSHOT_UPSERT' AS op, 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS row_key,
               {_CUSTOMER} AS after
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rk FROM customer)
        UNION ALL
        SELECT 1, 'snapshot:shop-sync:shop.orders:mysql-bin.000002:25000:' || (rk // 500), rk % 500, 'SNAPSHOT_UPSERT',
               'orders', CAST(o_orderkey AS VARCHAR),
               {_ORDERS}
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk FROM orders)""",
    "full_sync_progress": """
        SELECT 'shop-sync' AS connector, 'shop' AS database_name, 'customer' AS table_name, 'COMPLETED' AS status,
               'mysql-bin.000002' AS cutover_file, CAST(25000 AS BIGINT) AS cutover_position,
               '{"c_custkey":' || max(c_custkey) || '}' AS last_sent_pk, (count(*) + 499) // 500 AS n_pages, count(*) AS n_rows
        FROM customer
        UNION ALL
        SELECT 'shop-sync', 'shop', 'orders', 'COMPLETED', 'mysql-bin.000002', 25000,
               '{"o_orderkey":' || max(o_orderkey) || '}', (count(*) + 499) // 500, count(*) FROM orders""",
    "bootstrap_checkpoint": """
        SELECT 'shop-sync' AS connector, 'mysql-bin.000002' AS file, CAST(2 AS BIGINT) AS file_seq,
               CAST(25000 AS BIGINT) AS position""",
    "snapshot_plus_incremental": _with(
        f"""SELECT {_VIEW} FROM {_latest('''(
              SELECT database_name, table_name, row_key, op, image, file, file_seq, next_position, event_index, transaction_id,
                     arrival, list_pos FROM ch
              UNION ALL
              SELECT 'shop', 'user', CAST(c_custkey AS VARCHAR), 'SNAPSHOT_UPSERT',
                     ''' + _CUSTOMER + ''',
                     'mysql-bin.000002', 2, 25000, rk % 500,
                     'snapshot:shop-sync:shop.user:mysql-bin.000002:25000:' || (rk // 500), -1, rk % 500
              FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rk FROM customer))''', _BY_VERSION)}""", *_CH),
    "control_upsert": _with(
        """SELECT row_key AS connector, arg_max(file, event_id) AS file, CAST(arg_max(file_seq, event_id) AS BIGINT) AS file_seq,
                  CAST(arg_max(next_position, event_id) AS BIGINT) AS position, max(event_id) AS event_id
           FROM ch GROUP BY row_key""", *_CH),
    "control_append_once": _with(
        """SELECT transaction_id, min(event_id) AS event_id, arg_min(op, event_id) AS op FROM ch GROUP BY transaction_id""", *_CH),
    "rebuild_summary": _with(
        """SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running,
                  count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'FAILED') AS failed,
                  count(*) FILTER (status = 'OBSOLETE') AS obsolete FROM tk""", *_TASKS),
    "rebuild_gauges": _with(
        """SELECT count(*) FILTER (status = 'PENDING') AS pending_rebuild_tasks,
                  count(*) FILTER (status = 'FAILED') AS failed_rebuild_tasks FROM tk""", *_TASKS),
    "pipeline_metrics": _with(
        """SELECT count(*) FILTER (kind IN ('DML_TX', 'SNAPSHOT_ROW') AND result = 'PUBLISHED') AS events_published,
                  CAST(sum(n_rows) FILTER (kind = 'SNAPSHOT_ROW') AS BIGINT) AS snapshot_rows_sent,
                  count(*) FILTER (kind = 'DML_TX' AND result IN ('SUCCESS', 'BUFFERED')) AS events_consumed,
                  count(*) FILTER (kind = 'DML_TX' AND result = 'FAILED') AS events_failed,
                  count(*) FILTER (result = 'DUPLICATE') AS events_duplicate,
                  count(*) FILTER (kind = 'CHECKPOINT') AS checkpoint_saves,
                  count(*) FILTER (kind = 'REBUILD' AND result = 'STARTED') AS rebuilds_started,
                  count(*) FILTER (kind = 'REBUILD' AND result = 'SUCCESS') AS rebuilds_completed,
                  count(*) FILTER (kind = 'REBUILD' AND result = 'FAILED') AS rebuilds_failed FROM outc""", "ev", "outc"),
    "rebuild_durations": _with(
        """SELECT count(*) AS n, CAST(sum(n * 7 + 1) * 1000 AS BIGINT) AS total_ms, CAST(max(n * 7 + 1) * 1000 AS BIGINT) AS max_ms
           FROM att WHERE succeeded""", *_TASKS, "att"),
    "recent_tasks": _with(
        "SELECT task_id, status, updated_at FROM tk ORDER BY updated_at DESC, task_id DESC LIMIT 20", *_TASKS),
    "recent_failed_tasks": _with(
        """SELECT task_id, status, updated_at FROM tk WHERE status = 'FAILED' ORDER BY updated_at DESC, task_id DESC LIMIT 20""",
        *_TASKS),
    "recent_events": _with(
        """SELECT ts, kind AS event_type, database_name, table_name, reference, result FROM outc
           ORDER BY ts DESC, event_id DESC LIMIT 50""", "ev", "outc"),
    "recent_full_sync": """
        SELECT 'shop' AS database_name, CAST(user_id AS VARCHAR) AS table_name, max(ts) AS started_at FROM events
        GROUP BY user_id ORDER BY started_at DESC, table_name DESC LIMIT 10""",
    "connector_status": _with(
        """SELECT c.connector, 'SNAPSHOT_THEN_INCREMENTAL' AS startup_strategy, file, CAST(position AS BIGINT) AS position,
                  file IS NOT NULL AS checkpoint_present,
                  (SELECT count(*) FROM tk WHERE status = 'RUNNING') AS running_rebuilds,
                  (SELECT count(*) FROM tk WHERE status = 'FAILED') AS failed_rebuilds
           FROM (SELECT unnest(['shop-sync', 'fresh']) AS connector) c LEFT JOIN stored_cp s ON s.connector = c.connector""",
        *_TASKS, "stored_cp"),
    "overview_states": _with(
        """SELECT 'shop' AS database_name, table_name, status,
                  CASE WHEN status = 'ACTIVE' THEN last_type ELSE 'DROP_COLUMN' END AS ddl_type,
                  CAST(CASE WHEN status = 'ACTIVE' THEN l_pos ELSE d_pos END AS BIGINT) AS next_position
           FROM rstatus""", "ev", "rddl", "rstate", "rstatus"),
}

_SQL["table_catalogue"] = """
    SELECT 'shop' AS database_name, t AS table_name, string_agg(column_name, ',' ORDER BY i) AS columns, pk AS primary_keys,
           CAST(o AS BIGINT) AS table_order, n_rows, n_keys
    FROM (SELECT 'customer' AS t, 0 AS o, 'c_custkey' AS pk, unnest(keys) AS column_name,
                 generate_subscripts(keys, 1) AS i
          FROM (SELECT json_keys(to_json(c)) AS keys FROM customer c LIMIT 1)
          UNION ALL
          SELECT 'orders', 1, 'o_orderkey', unnest(keys), generate_subscripts(keys, 1)
          FROM (SELECT json_keys(to_json(c)) AS keys FROM orders c LIMIT 1)
          UNION ALL
          SELECT 'conversations', 2, 'conv_id,turn', unnest(keys), generate_subscripts(keys, 1)
          FROM (SELECT json_keys(to_json(c)) AS keys FROM conversations c LIMIT 1))
    JOIN (SELECT 'customer' AS t, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys FROM customer
          UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) FROM orders
          UNION ALL SELECT 'conversations', count(*), count(DISTINCT (conv_id, turn)) FROM conversations) USING (t)
    GROUP BY t, pk, o, n_rows, n_keys"""
_SQL["table_snapshot"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate) FROM orders"
_SQL["change_log_round_trip"] = _with(
    f"""SELECT {_FILE} AS file, CAST(pos AS BIGINT) AS pos, type, CAST(table_id AS BIGINT) AS table_id FROM log
        UNION ALL SELECT {_FILE}, CAST(pos AS BIGINT), 'QUERY', NULL FROM queries_""", "ev", "evr", "log", "queries_")
_SQL["message_round_trip"] = _SQL["envelopes"]
_SQL["rebuild_run"] = _with(
    f"""SELECT {_VIEW} FROM (
          SELECT *, 1 AS stored FROM staged
          UNION ALL
          SELECT *, 0 AS stored FROM {_latest("(SELECT * FROM ch WHERE table_name = 'user' AND event_id >= half)", _BY_VERSION)})
        QUALIFY row_number() OVER (PARTITION BY row_key
                                   ORDER BY file_seq DESC, next_position DESC, event_index DESC, stored DESC) = 1
        UNION ALL SELECT {_VIEW} FROM {_latest("(SELECT * FROM ch WHERE table_name = 'order')", _BY_VERSION)}""",
    *_CH, "staged")
_SQL["bootstrap_run"] = f"""
    SELECT table_name, row_key, after AS payload, CAST(25000 AS BIGINT) AS next_position, event_index, transaction_id
    FROM ({_SQL["bootstrap_rows"]})"""
_SQL["stream_latest_state"] = _SQL["latest_state_meta"]
_SQL["stream_fragments"] = _SQL["latest_state_meta"]
_SQL["captured_quarantine"] = _with(
    """SELECT transaction_id, CASE WHEN moved THEN 'PRIMARY_KEY_MUTATION' ELSE 'PUBLISHED' END AS reason,
              CAST(CASE WHEN moved THEN 1 ELSE count(*) END AS BIGINT) AS n_rows
       FROM (SELECT *, 'shop-sync:' || printf('mysql-bin.%06d', commit_file_seq) || ':' || commit_xid || ':'
                    || commit_position AS transaction_id
             FROM imgs WHERE commit_xid IS NOT NULL)
       GROUP BY transaction_id, moved, CASE WHEN moved THEN event_id * 2 + row_pos END""", *_IMGS)
_SQL["stream_arrival_state"] = _SQL["latest_state_simple"]
_SQL["stream_transactions"] = _SQL["event_index"]
_SQL["stream_end_to_end"] = _with(
    """SELECT table_name, CAST(id AS VARCHAR) AS row_key, op = 'DELETE' AS deleted, CAST(commit_file_seq AS BIGINT) AS file_seq,
              CAST(commit_position AS BIGINT) AS next_position, CAST(event_index AS BIGINT) AS event_index, transaction_id
       FROM txrows
       QUALIFY row_number() OVER (PARTITION BY table_name, id
                                  ORDER BY commit_file_seq DESC, commit_position DESC, event_index DESC) = 1""", *_TXROWS)
_SQL["stream_checkpoint"] = _SQL["connector_checkpoint"]
_SQL["stream_routed"] = _with(
    """SELECT t.transaction_id, CASE WHEN b.transaction_id IS NOT NULL THEN 'BUFFERED' ELSE 'APPLIED' END AS route
       FROM (SELECT DISTINCT transaction_id FROM rt) t LEFT JOIN oblock b USING (transaction_id)""", *_ORDERED)
_SQL["partitioned_feed"] = _SQL["stream_routed"]
_SQL["stream_quarantine"] = _with(
    """SELECT DISTINCT CAST(m_arrival AS BIGINT) AS arrival, poison AS reason FROM msg WHERE poison IS NOT NULL
       UNION ALL
       SELECT CAST(m_arrival AS BIGINT), arg_min(problem, event_index) FROM problems WHERE problem IS NOT NULL
       GROUP BY m_arrival""", *_MSG, "decoded", "problems")

_SQL["stream_dedupe_bounded"] = f"SELECT transaction_id, arrival FROM ({_SQL['dedupe_transactions']})"
_SQL["operations_overview"] = f"""
    SELECT 'checkpoint' AS part, connector AS item, file || ' ' || position AS detail FROM ({_SQL["connector_checkpoint"]})
    UNION ALL
    SELECT 'full_sync_tasks', table_name, status || ' ' || last_sent_pk || ' -' FROM ({_SQL["full_sync_progress"]})
    UNION ALL
    SELECT 'rebuild_summary', 'tasks', count(*) || ' 0 0 0 0' FROM ({_SQL["rebuild_tasks"]})
    UNION ALL
    SELECT 'schema_states', table_name, status || ' ' || ddl_type || ' ' || next_position FROM ({_SQL["schema_state"]})
    UNION ALL
    SELECT 'recent_events', 'events', 'true' FROM (SELECT event_id FROM events LIMIT 50)"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
