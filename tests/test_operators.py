"""Operators on small inputs: scenarios, error cases, and row-by-row models."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from model import MetaModel, SimpleModel, assemble as assemble_model
from rowtide import schemas as S, session
from rowtide.functions.ddl import changed_columns, column_changes, ddl_target, ddl_type, quote, unquote
from rowtide.functions.values import bare_pattern, base64_text, iso_instant, json_string, map_json
from rowtide.functions.versions import business_key, file_seq, is_newer, key_text, normalize_op, row_version, view_action
from rowtide.operators import assemble, control, ddl, envelope, fold, ops, rebuild, shape, snapshot
from rowtide.operators.ordered import Blocks, arrival_blocks, carry_last, fit_blocks, with_blocks
from rowtide.plans import feed
from rowtide.session import clear_scratch, lookup_join, materialize, path_exists, pin_small, scratch_scope, shared_dir
from rowtide.sources.catalog import TableSpec, attach_layouts, catalog_from_session, load_catalog
from rowtide.sources.changelog import read_change_log
from rowtide.sources.envelopes import read_envelopes, write_envelopes
from rowtide.sources.tables import read_table


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


# --- functions ------------------------------------------------------------------------------------


def test_file_sequence_and_versions(spark):
    names = ["mysql-bin.000010", "bin", "", None, "x.9", "7"]
    got = spark.createDataFrame([(n,) for n in names], "f string").select(file_seq("f")).collect()
    assert [r[0] for r in got] == [10, -1, -1, -1, 9, 7]
    version = lambda a, b, c: row_version(F.lit(a), F.lit(b), F.lit(c))
    ordered = [(10, 120, 0), (10, 120, 1), (10, 125, 0), (11, 4, 0)]
    for low, high in zip(ordered, ordered[1:]):
        assert one(spark, is_newer(version(*high), version(*low)))
        assert not one(spark, is_newer(version(*low), version(*high)))
    assert not one(spark, is_newer(version(1, 2, 3), version(1, 2, 3)))
    assert one(spark, is_newer(version(1, 2, 3), F.lit(None).cast("struct<file_seq:bigint,next_position:bigint,event_index:bigint>")))


def test_keys(spark):
    pk = F.create_map(F.lit("tenant"), F.lit("7"), F.lit("user"), F.lit(None).cast("string"))
    assert one(spark, key_text(pk)) == "7:null"
    db, table, key = F.lit("shop"), F.lit("user"), F.lit("1")
    assert one(spark, business_key(db, table, key)) == "cdc:shop.user:1"
    assert one(spark, business_key(db, table, key, "TABLE", "p:")) == "p:user:1"
    with pytest.raises(Exception, match="identity"):
        one(spark, business_key(F.lit(" "), table, key))
    with pytest.raises(ValueError):
        business_key(db, table, key, "OTHER")
    assert one(spark, normalize_op(F.lit("SNAPSHOT_UPSERT"))) == "UPDATE"
    assert one(spark, view_action(F.lit("DELETE"))) == "DEL"
    assert one(spark, view_action(F.lit("UNKNOWN"))) is None


def test_values(spark):
    for text, expected in [
        ("2024-01-01 00:00:00", "2024-01-01T00:00:00Z"),
        ("2024-01-01 01:02:03.5", "2024-01-01T01:02:03.500Z"),
        ("2024-01-01 01:02:03.000001", "2024-01-01T01:02:03.000001Z"),
    ]:
        assert one(spark, iso_instant(F.lit(text).cast("timestamp"))) == expected
    long = one(spark, base64_text(F.lit("x" * 300).cast("binary")))
    assert "\n" not in long and len(long) == 400
    for value in ['a"b', "a\\b", "\n", "é", "\x01", "", "[x]", "]", None]:
        assert json.loads(one(spark, json_string(F.lit(value).cast("string")))) == value
    typed = spark.sql("SELECT timestamp_ntz'2024-01-01 05:06:00' a, timestamp_ntz'2024-01-01 05:06:07.25' b, date'2024-02-03' c, 5 d")
    assert tuple(shape.normalize_values(typed).first()) == ("2024-01-01T05:06", "2024-01-01T05:06:07.250", "2024-02-03", 5)


@pytest.mark.parametrize(
    "sql, kind, table",
    [
        ("ALTER TABLE user DROP COLUMN age", "DROP_COLUMN", ("shop", "user")),
        ("  alter table `Shop`.`order` rename column a to b", "RENAME_COLUMN", ("shop", "order")),
        ("ALTER TABLE user MODIFY COLUMN a int, ADD COLUMN b int", "MODIFY_COLUMN", ("shop", "user")),
        ("ALTER TABLE user ADD COLUMN a int, DROP COLUMN b", "DROP_COLUMN", ("shop", "user")),
        ("ALTER TABLE user ADD COLUMN a int", "ADD_COLUMN", ("shop", "user")),
        ("ALTER TABLE user DROP age", None, ("shop", "user")),
        ("TRUNCATE TABLE user", None, (None, None)),
        ("BEGIN", None, (None, None)),
    ],
)
def test_ddl(spark, sql, kind, table):
    assert one(spark, ddl_type(F.lit(sql))) == kind
    target = one(spark, ddl_target(F.lit("shop"), F.lit(sql)))
    assert (target.database_key, target.table_key) == table


@pytest.mark.parametrize(
    "sql, columns, keys, bare",
    [
        ("ALTER TABLE t DROP COLUMN b", "id,c", "id", "id"),
        ("alter table shop.t drop B, add column (d decimal(10,2), `e f` enum('x,y','(')) ;", "id,c,d,e f", "id", "id,d"),
        ("ALTER TABLE `t` ADD COLUMN d INT UNSIGNED NOT NULL DEFAULT (1 + (2)) FIRST", "d,id,b,c", "id", "id,d"),
        ("ALTER TABLE t ADD d varchar(9) COMMENT 'first, after c' AFTER `ID`, DROP COLUMN c", "id,d,b", "id", "id"),
        ("ALTER TABLE t RENAME COLUMN id TO key1, RENAME COLUMN b TO `c``x`", "key1,c`x,c", "key1", "key1"),
        ("ALTER TABLE t CHANGE COLUMN id no bigint AFTER c, MODIFY b float", "b,c,no", "no", "no,b"),
        ("ALTER TABLE t MODIFY COLUMN id varchar(3), MODIFY c text FIRST", "c,id,b", "id", ""),
        ("ALTER TABLE t ADD KEY (b, c), DROP INDEX x, ADD UNIQUE KEY u (c), DROP PRIMARY KEY, RENAME TO z", "id,b,c", "id", "id"),
        ("ALTER TABLE t ADD COLUMN IF NOT EXISTS b int, DROP COLUMN IF EXISTS nope, ALTER COLUMN c SET DEFAULT 3", "id,b,c", "id", "id"),
        ("ALTER TABLE t /* DROP COLUMN b, */ ENGINE = x, COMMENT = 'drop column b'", "id,b,c", "id", "id"),
        ("ALTER TABLE t ADD COLUMN d int, ADD COLUMN e int AFTER d, DROP COLUMN d", "id,b,c,e", "id", "id,e"),
    ],
)
def test_column_changes(spark, sql, columns, keys, bare):
    start = F.struct(*[F.array(*map(F.lit, x)).alias(n) for n, x in (("columns", ["id", "b", "c"]), ("primary_keys", ["id"]), ("bare", ["id"]))])
    got = one(spark, changed_columns(start, column_changes(F.lit(sql))))
    assert (",".join(got.columns), ",".join(got.primary_keys), ",".join(got.bare)) == (columns, keys, bare)


def test_layouts_go_on_from_stored_ones(spark):
    catalog = load_catalog(spark, [TableSpec("shop", "user", ("id", "a"), ("id",), ("id",)), TableSpec("shop", "order", ("id",), ("id",))])
    query = lambda pos, sql, seq=0: ("c", "bin.000007", pos, seq, "QUERY", "shop", sql)
    log = lambda *listed: spark.createDataFrame(
        list(listed), "connector string, file string, pos bigint, seq bigint, type string, database_name string, sql string")
    first = ddl.layout_history(log(query(30, "alter table user add b int"), query(10, "alter table user drop column a"),
                                   query(20, "alter table other drop a"), query(40, "alter table user add key (id)")), catalog)
    columns = ("table_name", "position", "columns", "bare")
    assert rows(first, *columns) == [("user", 10, ["id"], ["id"]), ("user", 30, ["id", "b"], ["id", "b"])]
    again = log(query(30, "alter table user add b int"), query(50, "alter table USER rename column b to c"), query(60, "alter table `order` add x text"))
    second = ddl.layout_history(again, catalog, first)
    assert rows(second, *columns) == [("order", 60, ["id", "x"], []), ("user", 50, ["id", "c"], ["id", "c"])]
    known = attach_layouts(catalog, first.unionByName(second)).filter("table_name = 'user'").first()
    assert [x.since.position for x in known.layouts] == [10, 30, 50]
    from rowtide.functions.values import bare_pattern

    assert re.findall(known.layouts[2].bare_pattern.replace("\\Q", "").replace("\\E", ""), '{"id":"1","c":"2"}') == re.findall(
        bare_pattern(["id", "c"]), '{"id":"1","c":"2"}')
    assert ddl.layout_history(log(query(1, "BEGIN")), catalog, first).count() == 0


def test_guards_hold_whatever_is_selected(spark):
    bad = spark.createDataFrame([(1, "UPDATE", True), (2, "UPDATE", False)], "v int, op string, pk_changed boolean")
    with pytest.raises(Exception, match="primary key mutation"):
        shape.check_pk_stable(bad, "raise")[0].select("v").collect()
    assert rows(shape.check_pk_stable(bad.filter("NOT pk_changed"), "raise")[0].select("v"), "v") == [(2,)]
    unknown = spark.createDataFrame([("shop", "nobody", 5)], "database_name string, table_name string, v int")
    with pytest.raises(Exception, match="no metadata"):
        shape.join_metadata(unknown, feed.catalog(spark)).select("v").collect()


def test_quoting(spark):
    assert one(spark, quote(F.lit("a`b"))) == "`a``b`"
    assert one(spark, unquote(F.lit(" `a b` "))) == "a b"


# --- catalogue and sources ------------------------------------------------------------------------


def test_catalog_errors(spark):
    with pytest.raises(ValueError, match="no table"):
        load_catalog(spark, [])
    with pytest.raises(ValueError, match="no columns"):
        load_catalog(spark, [TableSpec("shop", "user", (), ("id",))])
    with pytest.raises(ValueError, match="no primary key"):
        load_catalog(spark, [TableSpec("shop", "user", ("id",), ())])
    with pytest.raises(ValueError, match="no columns"):
        catalog_from_session(spark, [("default", "missing_table")], {})


def test_sources_round_trip(spark, sf, tmp_path):
    raw = feed.raw_log(spark, sf)
    for fmt in ("parquet", "json"):
        raw.write.format(fmt).save(str(tmp_path / fmt))
        assert read_change_log(spark, str(tmp_path / fmt), fmt).exceptAll(raw).count() == 0
    sent = feed.as_messages(feed.changes(spark, sf))
    write_envelopes(sent, str(tmp_path / "topic"))
    assert read_envelopes(spark, str(tmp_path / "topic")).exceptAll(sent).count() == 0
    spec = TableSpec("shop", "customer", ("c_name", "c_custkey"), ("c_custkey",))
    table = read_table(spark, spec, f"{sf}/customer.parquet")
    assert table.columns == ["c_name", "c_custkey"]
    with pytest.raises(Exception, match="kafka"):
        read_envelopes(spark, "topic", "kafka")


def test_scratch_and_pinning(spark):
    with scratch_scope(spark):
        kept = materialize(spark.range(5), "t")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)
    clear_scratch(spark)
    assert shared_dir(spark)
    assert pin_small(spark.range(10), 10)[1] and not pin_small(spark.range(11), 10)[1]


def test_lookup_join_is_the_same_beyond_the_bound(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        expected = rows(big.join(small, "k", how), "k", "id", "v")
        assert rows(lookup_join(big, small, ["k"], how), "k", "id", "v") == expected
        assert rows(lookup_join(big, small, ["k"], how, spread=["id"], max_rows=5), "k", "id", "v") == expected


# --- raw log -----------------------------------------------------------------------------------------


def random_log(seed, n=400):
    """Entries of two connectors with several files, missing maps and commits at random."""
    rng, out = random.Random(seed), []
    for connector in ("a", "b"):
        for file in (1, 2, 3):
            pos = 0
            for _ in range(n // 6):
                pos += rng.choice([1, 30, 300])
                kind = rng.choices(["TABLE_MAP", "WRITE", "DELETE", "XID", "QUERY"], [3, 5, 2, 2, 1])[0]
                values = [{"before": None if kind == "WRITE" else [str(rng.randint(0, 9)), "5"],
                           "after": [str(rng.randint(0, 9)), "5"] if kind == "WRITE" else None}
                          for _ in range(rng.randint(1, 3))]
                out.append({
                    "connector": connector, "file": f"bin.{file}", "pos": pos, "seq": 0, "type": kind,
                    "table_id": rng.choice([1, 2, 3]) if kind in ("TABLE_MAP", "WRITE", "DELETE") else None,
                    "database_name": "shop", "table_name": rng.choice(["user", "order", "other"]) if kind == "TABLE_MAP" else None,
                    "rows": values if kind in ("WRITE", "DELETE") else None, "xid": len(out), "sql": None, "ts_ms": 1,
                })
    return out


@pytest.mark.parametrize("seed, blocks", [(1, Blocks(span=50)), (2, Blocks(span=1)), (3, Blocks(files=2)), (4, Blocks())])
def test_assembly_equals_model_for_any_block_size(spark, seed, blocks):
    log = random_log(seed)
    catalog = feed.catalog(spark)
    df = spark.createDataFrame(log, spark.createDataFrame([], S.RAW).schema).repartition(5)
    grouped = assemble.commit_groups(df, catalog, blocks)
    changes, tail = assemble.assemble_changes(grouped, catalog)
    got = {}
    for r in changes.collect():
        got.setdefault((r.connector, r.xid, r.file, r.next_position), []).append((r.event_index, r.table_name, r.op))
    n_open = 0
    expected = {}
    for connector in ("a", "b"):
        txns, open_rows = assemble_model([e for e in log if e["connector"] == connector], {"user", "order"})
        n_open += open_rows
        for xid, file, pos, listed in txns:
            names = {"WRITE": "INSERT", "DELETE": "DELETE"}
            expected[(connector, xid, file, pos)] = [(i, t, names[k]) for i, (t, k, _) in enumerate(listed)]
    assert {k: sorted(v) for k, v in got.items()} == expected
    assert (tail.filter("configured").agg(F.sum(F.size("rows"))).first()[0] or 0) == n_open


def test_blocks_are_bounded(spark):
    log = spark.createDataFrame([("bin.000001",), ("bin.5000000",)], "file string")
    assert fit_blocks(log) == Blocks() and fit_blocks(log, 1) == Blocks(files=2)
    # Files as long as a block keep the cut inside files.
    long = log.withColumn("pos", F.lit(1 << 40))
    assert fit_blocks(long, 1) == Blocks() and fit_blocks(log.withColumn("pos", F.lit(5)), 1) == Blocks(files=2)


def test_carry_last_crosses_blocks(spark):
    data = [(k, i, i if (i * 7 + k) % 11 == 0 else None) for k in (0, 1) for i in range(100)]
    df = spark.createDataFrame(data, "k int, arrival bigint, v int")
    got = carry_last(arrival_blocks(df, "arrival", 8), ["k"], ["arrival"], F.col("v"), "last_v")
    state, expected = {}, []
    for k, i, v in data:
        state[k] = v if v is not None else state.get(k)
        expected.append((k, i, state[k]))
    assert rows(got, "k", "arrival", "last_v") == sorted(expected, key=str)


def test_pk_rules(spark):
    catalog = feed.catalog(spark)
    log = [
        {"type": "TABLE_MAP", "pos": 1, "table_id": 10, "database_name": "shop", "table_name": "user"},
        {"type": "UPDATE", "pos": 2, "table_id": 10, "rows": [{"before": ["1", "5"], "after": ["2", "6"]}]},
        {"type": "XID", "pos": 3, "xid": 9},
    ]
    base = {c: None for c in spark.createDataFrame([], S.RAW).columns}
    schema = spark.createDataFrame([], S.RAW).schema
    df = spark.createDataFrame([{**base, "connector": "c", "file": "b.1", "seq": 0, "ts_ms": 0, **e} for e in log], schema)
    grouped = assemble.commit_groups(df, catalog)
    with pytest.raises(Exception, match="primary key mutation"):
        assemble.assemble_changes(grouped, catalog)[0].collect()
    assert assemble.assemble_changes(grouped, catalog, "quarantine")[0].count() == 0
    with pytest.raises(ValueError):
        assemble.assemble_changes(grouped, catalog, "other")
    unknown = grouped.withColumn("table_name", F.lit("nowhere"))
    with pytest.raises(Exception, match="no metadata"):
        shape.join_metadata(unknown.filter("type = 'UPDATE'"), catalog).select("columns").collect()
    image = F.create_map(F.lit("a"), F.lit("1"))
    assert one(spark, shape.extract_pk(image, F.array(F.lit("a"), F.lit("b")))) == {"a": "1", "b": None}
    assert one(spark, assemble.event_time(F.lit(0), F.lit(77))) == 77
    assert one(spark, assemble.event_time(F.lit(5), F.lit(77))) == 5


def test_checkpoint_rules(spark):
    cases = [(1, 1, 0, 0, True), (2, 0, 0, 0, True), (3, 0, 2, 1, True), (4, 0, 2, 0, False)]
    commits = spark.createDataFrame(
        [("c", f"b.{g}", g * 100, n, i, x) for g, n, i, x, _ in cases],
        "connector string, file string, next_position bigint, n_rows bigint, n_ignored bigint, n_ignored_external bigint",
    )
    assert [r[0] for r in commits.orderBy("file").select(assemble.advances_checkpoint()).collect()] == [c[-1] for c in cases]
    assert rows(assemble.advance_checkpoint(commits), "file", "position") == [("b.3", 300)]
    connectors = spark.createDataFrame([("c",), ("d",)], "connector string")
    stored = spark.createDataFrame([("c", "b.1", 1, 10)], S.CHECKPOINT)
    head = spark.createDataFrame([("c", "b.9", 9, 90), ("d", "b.8", 8, 80)], S.CHECKPOINT)
    latest = assemble.resolve_start(connectors, stored, head, "LATEST")
    assert rows(latest) == [("c", "RESUME", "b.1", 10), ("d", "LATEST", "b.8", 80)]
    assert rows(assemble.resolve_start(connectors, stored, head, "LATEST", checkpointing=False), "action") == [("DEFAULT",)] * 2
    with pytest.raises(ValueError):
        assemble.resolve_start(connectors, stored, head, "SNAPSHOT_THEN_INCREMENTAL", checkpointing=False)
    with pytest.raises(ValueError):
        assemble.resolve_start(connectors, stored, head, "EARLIEST")


# --- messages and folds ----------------------------------------------------------------------------


def test_envelope_text(spark):
    change = spark.createDataFrame(
        [("shop-sync", "mysql-bin.000001", 1, 345, 240, 1710000000000, "shop-sync:mysql-bin.000001:345:240", 0,
          "shop", "user", "INSERT", '{"id":1}', None, '{"id":1,"username":"alice"}')],
        "connector string, file string, file_seq bigint, xid bigint, next_position bigint, ts_ms bigint, transaction_id string, "
        "event_index bigint, database_name string, table_name string, op string, primary_key_json string, before string, after string",
    )
    sent = envelope.encode_transactions(assemble.assemble_transactions(change)).first()
    assert sent.key == "shop-sync:mysql-bin.000001:345:240"
    assert json.loads(sent.value) == {
        "messageType": "TRANSACTION",
        "transaction": {
            "transactionId": "shop-sync:mysql-bin.000001:345:240", "connectorName": "shop-sync",
            "binlogFilename": "mysql-bin.000001", "xid": 345, "nextPosition": 240, "timestamp": 1710000000000,
            "events": [{"database": "shop", "table": "user", "eventIndex": 0, "eventType": "INSERT",
                        "primaryKey": {"id": 1}, "before": None, "after": {"id": 1, "username": "alice"}}],
        },
        "schemaChange": None,
    }


def test_poison_reasons(spark):
    values = ["not-json", "null", " null ", None, "", "[]", '{"other":1}']
    sent = spark.createDataFrame([("t", 0, i, "k", 0, v) for i, v in enumerate(values)], S.MESSAGES)
    good, poison = envelope.decode_envelopes(sent)
    assert rows(poison, "arrival", "reason") == [
        (0, "MALFORMED"), (1, "JSON_NULL"), (2, "JSON_NULL"), (3, "NULL_PAYLOAD"), (4, "MALFORMED"), (5, "MALFORMED")]
    assert [d.count() for d in envelope.split_messages(good)] == [0, 0, 1]


def test_one_bad_fragment_rejects_the_whole_transaction(spark, sf):
    base = feed.changes(spark, sf).withColumn("op", F.when(F.col("event_id") == 2, "UNKNOWN").otherwise(F.col("op")))
    txns = feed.transactions_of(feed.as_messages(base, max_events=1))
    ok, rejected = envelope.validate_transactions(txns)
    assert rejected.count() == 4 and {r.reason for r in rejected.collect()} == {"eventType"}
    assert ok.count() == base.count() - 4
    whole = feed.transactions_of(feed.as_messages(feed.changes(spark, sf)))
    cut = feed.transactions_of(feed.as_messages(feed.changes(spark, sf), max_events=3))
    assert rows(fold.fold_arrival(envelope.explode_rows(cut))) == rows(fold.fold_arrival(envelope.explode_rows(whole)))


def random_transactions(seed, n=120):
    rng, out = random.Random(seed), []
    for i in range(n):
        listed = [
            {"table": rng.choice(["user", "order"]), "key": str(rng.randint(0, 6)),
             "op": (op := rng.choice(["INSERT", "UPDATE", "DELETE", "SNAPSHOT_UPSERT"])),
             "after": None if op == "DELETE" else json.dumps({"v": f"{i}-{j}"})}
            for j in range(rng.randint(1, 4))
        ]
        out.append({"id": f"t{rng.randint(0, n)}", "file": f"bin.{rng.randint(8, 11)}", "pos": rng.randint(1, 9) * 10, "rows": listed})
    return out


def as_rows(spark, txns):
    listed = [
        (t["id"], 0, arrival, t["file"], "c", t["pos"], i, i, "shop", r["table"], r["key"], r["op"], r["after"])
        for arrival, t in enumerate(txns) for i, r in enumerate(t["rows"])
    ]
    return spark.createDataFrame(
        listed,
        "transaction_id string, fragment int, arrival bigint, file string, connector string, next_position bigint, "
        "event_index bigint, list_pos bigint, database_name string, table_name string, row_key string, op string, after string",
    ).withColumn("file_seq", file_seq("file"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_equal_row_by_row_models(spark, seed):
    txns = random_transactions(seed)
    meta, simple = MetaModel(), SimpleModel()
    outcomes = [meta.apply(t) for t in txns]
    assert outcomes == [simple.apply(t) for t in txns]
    all_rows = as_rows(spark, txns)
    headers = all_rows.select("transaction_id", "fragment", "arrival").distinct()
    first = fold.dedupe_transactions(headers)
    assert first.count() == outcomes.count("APPLIED")
    kept = all_rows.join(first, ["transaction_id", "fragment", "arrival"], "left_semi")
    folded = fold.fold_latest(kept)
    assert {(r.table_name, r.row_key): r.payload for r in fold.live(folded).collect()} == meta.values
    assert {(r.table_name, r.row_key): (r.deleted, (r.file_seq, r.next_position, r.event_index)) for r in folded.collect()} == meta.meta
    arrival = fold.live(fold.fold_arrival(kept))
    assert {(r.table_name, r.row_key): r.payload for r in arrival.collect()} == simple.values
    # Any split into batches merged one after the other gives the same view.
    cut = len(txns) // 3
    parts = [kept.filter(F.col("arrival").between(a, b)) for a, b in ((0, cut), (cut + 1, 2 * cut), (2 * cut + 1, 10_000))]
    view = fold.fold_latest(parts[0])
    for part in parts[1:]:
        view = fold.merge_view(view, fold.fold_latest(part))
    columns = ["table_name", "row_key", "deleted", "payload", "next_position"]
    assert rows(view, *columns) == rows(folded, *columns)


def test_dedupe_is_the_same_beyond_the_bound(spark, sf, monkeypatch):
    txns = feed.transactions_of(feed.repeated_messages(spark, sf)).select("transaction_id", "fragment", "arrival", "value")
    odd = spark.createDataFrame(
        [(None, 0, 1, "a"), (None, 0, 1, "a"), (None, 0, 2, "b"), ("tie", 0, 5, "x"), ("tie", 0, 5, "y"), ("same", 0, 7, "z"), ("same", 0, 7, "z"),
         ("cut", 0, 3, "p"), ("cut", 1, 4, "q"), ("cut", 1, 9, "q")], txns.schema)
    txns = txns.unionByName(odd)
    expected = rows(fold.dedupe_transactions(txns), "transaction_id", "fragment", "arrival", "value")
    monkeypatch.setattr(session, "pin_small", lambda df, max_rows=0: (df, False))
    assert rows(fold.dedupe_transactions(txns), "transaction_id", "fragment", "arrival", "value") == expected
    kept = [r[:3] for r in expected if r[0] in (None, "tie", "same", "cut")]
    assert sorted(kept, key=str) == sorted([(None, 0, 1), (None, 0, 1), (None, 0, 2), ("tie", 0, 5), ("same", 0, 7), ("cut", 0, 3), ("cut", 1, 4)], key=str)


def test_text_rules(spark):
    """Control characters at the ends do not count, bare values are JSON, quoted identifiers are unescaped."""
    sql = spark.createDataFrame([("\n\tALTER TABLE `a``b` . c$1 DROP COLUMN x\r\n",), ("alter table ü.`t`\nadd column y int",)], "sql string")
    got = sql.select(ddl_type(F.col("sql")).alias("k"), ddl_target(F.lit("d"), F.col("sql")).alias("t")).collect()
    assert [(r.k, tuple(r.t)) for r in got] == [("DROP_COLUMN", ("a`b", "c$1")), (None, ("ü", "t"))]
    values = ["", "7", "-1.5e3", "007", "true", "x", "1."]
    image = F.create_map(F.lit("cents"), F.col("v"), F.lit("t"), F.lit('"cents":"7"'))
    text = spark.createDataFrame([(v,) for v in values], "v string").select(map_json(image, F.lit(bare_pattern(["cents"]))).alias("j"))
    assert [json.loads(r.j)["cents"] for r in text.collect()] == ["", 7, -1500.0, "007", True, "x", "1."]
    payloads = spark.createDataFrame([(i, "k", v) for i, v in enumerate(["\n", "\t ", "\nnull\r", "{}", None])], "arrival bigint, key string, value string")
    reasons = envelope.parse_messages(payloads.withColumn("fragment", F.lit(0))).select("arrival", "reason")
    assert rows(reasons, "arrival", "reason") == [(0, "MALFORMED"), (1, "MALFORMED"), (2, "JSON_NULL"), (3, None), (4, "NULL_PAYLOAD")]


def test_table_scope_needs_no_database(spark):
    event = spark.createDataFrame([("", "t", "DELETE", {"id": "1"}), ("d", " ", "DELETE", {"id": "1"})],
                                  "database string, `table` string, eventType string, primaryKey map<string,string>")
    event = event.withColumn("after", F.lit(None).cast("string"))
    whole = F.struct(*event.columns)
    judged = event.select(envelope.row_problem(whole).alias("a"), envelope.row_problem(whole, "TABLE").alias("b"))
    assert [tuple(r) for r in judged.collect()] == [("identity", None), ("identity", "identity")]


# --- schema state, rebuild, snapshot -----------------------------------------------------------------


def ddl_rows(spark, *listed):
    return spark.createDataFrame(
        [(f"ddl:{p}", "c", "shop", t, kind, "ALTER", "b.1", 1, p, 1, p) for t, kind, p in listed],
        S.SCHEMA_CHANGE + ", arrival bigint",
    )


def test_schema_state_rules(spark):
    changes = ddl_rows(spark, ("user", "DROP_COLUMN", 10), ("user", "ADD_COLUMN", 20), ("order", "ADD_COLUMN", 5))
    state = ddl.schema_state(changes)
    assert rows(state, "table_name", "status", "next_position") == [("order", "ACTIVE", 5), ("user", "REBUILD_REQUIRED", 10)]
    log = lambda status, pos: spark.createDataFrame(
        [("shop", "user", 1, pos, status, 1)],
        "database_name string, table_name string, file_seq bigint, next_position bigint, status string, seq bigint")
    done = ddl.schema_state(changes, log("ACTIVE", 10)).filter("table_name = 'user'")
    assert rows(done, "status", "ddl_type") == [("ACTIVE", "ADD_COLUMN")]
    old = ddl.schema_state(changes, log("ACTIVE", 7)).filter("table_name = 'user'")
    assert rows(old, "status") == [("REBUILD_REQUIRED",)]
    failed = ddl.schema_state(changes, log("REBUILD_FAILED", 10)).filter("table_name = 'user'")
    assert rows(failed, "status") == [("REBUILD_FAILED",)]
    assert rows(ddl.intake_ddl(changes), "task_id") == [("shop.user:b.1:10",)]


def test_target_spelling_and_ambiguity(spark):
    catalog = load_catalog(spark, [TableSpec("Shop", "User", ("id",), ("id",)), TableSpec("shop", "user", ("id",), ("id",))])
    sql = spark.createDataFrame([("shop", "alter table USER drop column a"), ("shop", "alter table x.y drop column a")],
                                "database_name string, sql string")
    assert rows(ddl.resolve_ddl_table(sql, catalog), "database_name", "table_name") == [("Shop", "User")]


def test_replay_waits_for_all_blocking_tables(spark):
    pending = spark.createDataFrame(
        [("t1", 0, "c", "b.1", 1, 50, "{}", ["shop.a", "shop.b"], ["shop.a", "shop.b"], "b.1", 1, 20, "PENDING"),
         ("t2", 0, "c", "b.1", 1, 60, "{}", ["shop.a"], ["shop.a"], "b.1", 1, 10, "PENDING"),
         ("t3", 0, "c", "b.1", 1, 70, "{}", ["shop.aa"], ["shop.aa"], "b.1", 1, 10, "PENDING")], S.PENDING)
    tasks = ddl.intake_ddl(ddl_rows(spark, ("a", "DROP_COLUMN", 10)))
    exact = rebuild.replay_candidates(pending, tasks)
    assert rows(exact, "transaction_id") == [("t2",)]
    every = rebuild.replay_candidates(pending, tasks, exact=False)
    assert rows(every, "transaction_id") == [("t1",), ("t2",)]
    states = ddl.schema_state(ddl_rows(spark, ("a", "DROP_COLUMN", 10), ("b", "DROP_COLUMN", 20)))
    table = lambda *names: spark.createDataFrame([("shop", n) for n in names], "database_name string, table_name string")
    assert rows(rebuild.replayable(every, states, table("a")), "transaction_id") == [("t2",)]
    assert rows(rebuild.replayable(every, states, table("a", "b")), "transaction_id") == [("t1",), ("t2",)]


def test_claim(spark):
    tasks = ddl.intake_ddl(ddl_rows(spark, ("a", "DROP_COLUMN", 10), ("b", "DROP_COLUMN", 20)))
    claimed = rebuild.claim(tasks, "shop.a:b.1:10")
    assert rows(claimed, "table_name", "status") == [("a", "RUNNING"), ("b", "PENDING")]
    assert rows(rebuild.claim(claimed, "shop.a:b.1:10"), "status") == rows(claimed, "status")
    assert rebuild.next_pending(claimed).first().table_name == "b"


def test_keyset_pages_walk_the_whole_table(spark):
    df = spark.range(57).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"), F.lit("x").alias("v"))
    cursor, seen = None, []
    while page := snapshot.keyset_page(df, ["a", "b"], cursor, 10).collect():
        seen += [(r.a, r.b) for r in page]
        cursor = {"a": page[-1].a, "b": page[-1].b}
    assert seen == sorted((i % 4, i) for i in range(57))
    with pytest.raises(ValueError, match="page size"):
        snapshot.keyset_page(df, ["a"], None, 0)
    with pytest.raises(ValueError, match="missing cursor value"):
        snapshot.keyset_page(df, ["a", "b"], {"a": 1}, 5)


@pytest.mark.parametrize("n_rows, n, pages", [(30, 10, 3), (70, 10, 7), (25, 10, 3), (0, 10, 0), (1, 5, 1)])
def test_paging(spark, n_rows, n, pages):
    df = spark.range(n_rows).select(F.col("id"), F.lit("v").alias("v")).repartition(3)
    paged = snapshot.paginate(df, ["id"], n, partitions=4)
    summary = snapshot.pages(paged, ["id"]).orderBy("page_index").collect()
    assert len(summary) == pages and sum(p.n_rows for p in summary) == n_rows
    assert [p.has_more for p in summary] == [(i + 1) * n <= n_rows for i in range(pages)]
    assert all(r.page_index * n + r.row_index == r.id for r in paged.collect())


def test_full_sync_failure(spark):
    specs = [TableSpec("shop", t, ("id",), ("id",), ("id",)) for t in ("user", "order", "item")]
    sent = spark.createDataFrame([("shop", "user", 0, 3, '{"id":3}')],
                                 "database_name string, table_name string, page_index bigint, n_rows bigint, last_pk string")
    failure = spark.createDataFrame([("shop", "order", S.PUBLISH_PAGE_ERROR, "kafka down")],
                                    "database_name string, table_name string, message string, root_cause string")
    progress = snapshot.full_sync_progress(load_catalog(spark, specs), sent, feed.CUTOVER, failure)
    assert rows(progress, "table_name", "status", "last_error") == [
        ("item", "RUNNING", None), ("order", "FAILED", "Failed to publish snapshot page.: kafka down"), ("user", "COMPLETED", None)]
    assert snapshot.bootstrap_checkpoint(progress).count() == 0
    with pytest.raises(ValueError):
        snapshot.bootstrap([], feed.CUTOVER)


def test_control_tables(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 3), ("b", 5), ("c", 4)], "k string, v int")
    assert rows(control.upsert(current, changes, ["k"], ["v"])) == [("a", 1), ("b", 5), ("c", 4)]
    assert rows(control.append_once(current, changes, ["k"], ["v"])) == [("a", 1), ("b", 2), ("c", 4)]


def test_recent_events_and_counters(spark):
    listed = [(i, kind, result, n) for i, (kind, result, n) in enumerate(
        [("SNAPSHOT_ROW", "PUBLISHED", 3), ("DML_TX", "DUPLICATE", None), ("DML_TX", "BUFFERED", None)])]
    log = spark.createDataFrame(listed, "seq bigint, event_type string, result string, n_rows bigint").withColumn(
        "ts", F.timestamp_seconds("seq"))
    assert [r.seq for r in ops.recent_events(log, 2).collect()] == [2, 1]
    counted = ops.pipeline_metrics(log).first()
    assert (counted.events_published, counted.snapshot_rows_sent, counted.events_consumed, counted.events_duplicate) == (1, 3, 1, 1)


def test_snapshot_images_of_every_type(spark):
    sql = """SELECT 1L AS id, timestamp_ntz'2020-01-02 03:04:00' AS wall, timestamp_ntz'2020-01-02 03:04:05.5' AS fine,
                    timestamp'2020-01-02 03:04:05Z' AS instant, date'2020-01-02' AS day, 1.5D AS x, X'FF' AS raw,
                    CAST(NULL AS timestamp_ntz) AS gone, true AS flag"""
    want = {
        "id": 1, "wall": "2020-01-02T03:04:00", "fine": "2020-01-02T03:04:05.5", "instant": "2020-01-02T03:04:05Z",
        "day": "2020-01-02", "x": 1.5, "raw": "/w==", "gone": None, "flag": True,
    }
    zone = spark.conf.get("spark.sql.session.timeZone")
    for session_zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            rows = spark.sql(sql)
            spec = TableSpec.of("shop", "t", rows, ["id", "wall"])
            paged = snapshot.paginate(rows, ["id", "wall"], 10)
            image = snapshot.snapshot_rows(paged, spec, snapshot.Cutover("c", "bin.000001", 4)).first()
            last = snapshot.pages(paged, ["wall"]).first().last_pk
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert list(json.loads(image.after).items()) == list(want.items())
        assert image.row_key == "1:2020-01-02T03:04:00" and json.loads(last) == {"wall": want["wall"]}


def test_a_lookup_beyond_its_bound_is_found_once(spark):
    """What reads the joined rows reads the small side as written, it does not compute it again."""
    big = spark.range(40).withColumnRenamed("id", "k")
    small = spark.range(40).groupBy((F.col("id") % 20).alias("k")).agg(F.count("*").alias("n"))
    joined = lookup_join(big, small, ["k"], max_rows=3)
    assert "Aggregate" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in joined.filter("n = 2").collect()) == list(range(20))


def test_wide_rows_are_written_in_small_row_groups(spark, tmp_path):
    """What a task reads at once ends with a row group; a default group takes all rows of this test, 20 MB."""
    from pyarrow import parquet

    from rowtide.sources.envelopes import write_envelopes
    from rowtide.sources.store import ChangeStore

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.sha2(F.concat_ws(":", "id", i), 512)), "")
    wide = spark.range(0, 200, 1, 1).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("arrival"), F.lit("k").alias("key"),
        F.lit(0).alias("fragment"), text.alias("value"),
    )
    store = ChangeStore(spark, f"{tmp_path}/store").create()
    store.write("messages", store.begin("w", "0"), wide)
    write_envelopes(wide, f"{tmp_path}/topic")
    kept = materialize(wide.select("arrival", F.array(F.struct("value")).alias("events")), "wide")
    folders = [tmp_path / "store" / "messages", tmp_path / "topic", Path(kept.inputFiles()[0].removeprefix("file:")).parent]
    for folder in folders:
        read = [parquet.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
        groups = [m.row_group(i).num_rows for m in read for i in range(m.num_row_groups)]
        assert sum(groups) == 200 and max(groups) <= 100, groups
    assert kept.select(F.sum(F.length(F.col("events")[0]["value"]))).first()[0] == 200 * 800 * 128


def test_a_lookup_beyond_its_bound_is_not_broadcast(spark):
    """However small its files are: the copies of its rows are not seen in their size."""
    big, small = (spark.range(40).withColumnRenamed("id", "k") for _ in range(2))
    for how in ("left", "inner", "left_semi", "left_anti"):
        for spread in (None, ["k"]):
            plan = lookup_join(big, small, ["k"], how, spread, max_rows=3)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_messages_are_parsed_once_to_tell_their_kinds(spark, sf):
    """One pass over the messages gives the kinds that the three parts of the split hold."""
    from rowtide.plans import queries

    found = queries.message_split(spark, sf)
    assert found._jdf.queryExecution().analyzed().toString().count("from_json") == 1
    good, _ = envelope.decode_envelopes(feed.messages(spark, sf))
    parts = zip(("SCHEMA_CHANGE", "TRANSACTION", "EMPTY"), envelope.split_messages(good))
    assert sorted(map(tuple, found.collect())) == sorted((r.arrival, kind) for kind, part in parts for r in part.collect())


def test_judging_transactions_writes_no_rows_of_theirs(spark, sf):
    from rowtide.plans import queries

    judged = feed.transactions_of(feed.messages(spark, sf), *queries.JUDGED)
    assert judged.columns == queries.JUDGED and judged.count() > 0
    _, rejected = envelope.validate_transactions(judged)
    _, whole = envelope.validate_transactions(feed.transactions_of(feed.messages(spark, sf)))
    assert sorted(r.arrival for r in rejected.collect()) == sorted(r.arrival for r in whole.collect())


def test_statements_alone_are_the_statements_of_the_whole_log(spark, sf):
    found = [ddl.schema_change_events(log, feed.catalog(spark)).select("event_id", "table_name", "raw_sql", "ts_ms").collect()
             for log in (feed.raw_log(spark, sf, feed.HAS_STATEMENT), feed.raw_log(spark, sf))]
    assert sorted(found[0]) == sorted(found[1]) and found[0]


def test_slices_with_given_numbers_do_not_read_the_rows(spark):
    from rowtide.plans.stream_queries import _slices

    unread = spark.range(10).select(F.raise_error(F.lit("read")).cast("bigint").alias("n"))
    assert len(_slices(unread, "n", spark.range(10).select(F.col("id").alias("n")))) == 2
    parts = _slices(spark.range(11).select(F.col("id").alias("n")), "n")
    assert sorted(r.n for p in parts for r in p.collect()) == list(range(11))


def test_decisions_read_no_rows_and_no_text_of_messages(spark, sf):
    """Ids, kinds, parts and repeats of parsed messages are found in single columns of what was written."""
    parsed = session.materialize(envelope.parse_messages(feed.repeated_messages(spark, sf)), "parsed")
    changes, txns, _ = envelope.split_messages(envelope.split_poison(parsed)[0])
    repeats = txns.groupBy("transaction_id", "fragment").agg(F.min(F.struct("arrival", "digest")))
    with_file = txns.select("transaction_id", "file_seq").distinct()
    for narrow in (changes.select("event_id"), txns.select("fragments"), repeats, with_file):
        plan = narrow._jdf.queryExecution().executedPlan()
        read = [scan.requiredSchema().simpleString() for scan in _scans(plan)]
        assert read and not any("events" in r or "value" in r for r in read), read
    kept = fold.dedupe_transactions(txns)
    assert rows(kept, "transaction_id", "arrival") == rows(fold.dedupe_transactions(txns.drop("digest")), "transaction_id", "arrival")


def _scans(plan):
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        return [plan]
    children = plan.children()
    return [scan for i in range(children.size()) for scan in _scans(children.apply(i))]


def test_a_lookup_finds_its_small_side_once_whatever_its_size(spark, monkeypatch):
    seen, real = [], session.pin_small

    def pin(df, max_rows):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, max_rows)

    monkeypatch.setattr(session, "pin_small", pin)
    small = spark.range(40).groupBy((F.col("id") % 20).alias("k")).agg(F.count("*").alias("n"))
    for bound in (3, 100):
        assert lookup_join(spark.range(5).withColumnRenamed("id", "k"), small, ["k"], max_rows=bound).filter("n = 2").count() == 5
    assert len(seen) == 2 and not any("Aggregate" in plan for plan in seen)


def test_late_rows_alone_are_those_of_the_stale_feed(spark, sf):
    columns = ["arrival", "transaction_id", "event_index", "after"]
    late = feed.late_changes(spark, sf)
    assert rows(late, *columns) == rows(feed.stale_changes(spark, sf).filter("arrival >= 1000000000"), *columns)
    assert late._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
