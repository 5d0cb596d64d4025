"""Streams against batch results, replays, failures and rebuilds."""

import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowtide.operators import assemble, envelope, fold, partitions
from rowtide.operators.ordered import Blocks
from rowtide.plans import feed
from rowtide.sources.changelog import stream_change_log
from rowtide.sources.catalog import TableSpec
from rowtide.sources.envelopes import read_envelopes, write_envelopes
from rowtide.sources.store import ChangeStore, ConflictError
from rowtide.streaming.apply import PoisonMessageError, RejectedTransactionError, apply_batch, drop_repeats, release_waiting, run_sync
from rowtide.streaming.capture import capture_batch, capture_stream
from rowtide.streaming.bootstrap_job import run_bootstrap
from rowtide.streaming.rebuild_job import run_rebuild


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def view_rows(df):
    return rows(df, "database_name", "table_name", "row_key", "deleted", "payload", "transaction_id")


def message(arrival, txn_id, pos, events, file="mysql-bin.000010"):
    listed = [
        {
            "database": "shop", "table": t, "eventIndex": i, "eventType": op,
            "primaryKey": {"id": key}, "before": None, "after": after,
        }
        for i, (t, op, key, after) in enumerate(events)
    ]
    txn = {
        "transactionId": txn_id, "connectorName": "c", "binlogFilename": file, "xid": 1, "nextPosition": pos,
        "timestamp": 1, "events": listed,
    }
    return ("t", 0, arrival, txn_id, 0, json.dumps({"messageType": "TRANSACTION", "transaction": txn}))


def ddl_message(arrival, table, kind, pos, file="mysql-bin.000010"):
    change = {
        "eventId": f"ddl:{file}:{pos}", "connectorName": "c", "database": "shop", "table": table, "ddlType": kind,
        "rawSql": "ALTER TABLE", "binlogFilename": file, "nextPosition": pos, "timestamp": 1000,
    }
    return ("t", 0, arrival, change["eventId"], 0, json.dumps({"messageType": "SCHEMA_CHANGE", "schemaChange": change}))


def messages(spark, *listed):
    return spark.createDataFrame(
        list(listed), "topic string, partition int, arrival bigint, key string, fragment int, value string"
    )


def test_stream_equals_batch_and_replay_changes_nothing(spark, sf, tmp_path):
    once = feed.as_messages(feed.changes(spark, sf))
    source = str(tmp_path / "topic")
    write_envelopes(once.repartitionByRange(2, "arrival"), source)
    store = ChangeStore(spark, str(tmp_path / "store")).create()
    stream = read_envelopes(spark, source, stream=True, max_files=1)
    assert run_sync(stream, store, str(tmp_path / "cp")) == 1
    expected = view_rows(fold.fold_latest(feed.changes(spark, sf)))
    assert view_rows(store.view()) == expected

    write_envelopes(once.withColumn("arrival", F.col("arrival") + 1_000_000).coalesce(1), source)
    run_sync(stream, store, str(tmp_path / "cp"))
    assert view_rows(store.view()) == expected
    assert {r.result for r in store.outcomes().select("result").distinct().collect()} == {"SUCCESS", "DUPLICATE"}



def test_late_messages_differ_by_mode(spark, sf, tmp_path):
    late = feed.stale_changes(spark, sf)
    first = feed.as_messages(late.filter("arrival < 1000000000"))
    second = feed.as_messages(late.filter("arrival >= 1000000000")).withColumn("arrival", F.col("arrival") + 1_000_000_000)
    for mode, folded in (
        ("meta", fold.fold_latest(late)),
        ("simple", fold.live(fold.fold_arrival(late))),
    ):
        store = ChangeStore(spark, str(tmp_path / mode), mode).create()
        apply_batch(store, first, 0)
        apply_batch(store, second, 1)
        assert rows(store.view(), "table_name", "row_key", "payload") == rows(folded, "table_name", "row_key", "payload")


def store_of(spark, path, mode="meta", buckets=4):
    return ChangeStore(spark, str(path), mode, buckets).create()


def insert(arrival, key, value="v", pos=None, table="user"):
    return message(arrival, f"t{arrival}", pos or 100 + arrival, [(table, "INSERT", key, {"id": key, "v": value})])


def test_batch_is_applied_once_and_a_broken_run_leaves_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path / "s")
    good = messages(spark, insert(0, 1))
    # What interrupted attempts left behind must not surface, neither the writer's own nor another's.
    for writer, name in (("apply", "7"), ("rebuild", "1")):
        batch = store.begin(writer, name)
        store.write("done", batch, spark.createDataFrame([("lost", 1)], "transaction_id string, file_seq bigint"))
        store._write_merged(batch, spark.createDataFrame([("shop", "user", "9", False, "{}", "f.1", 1, 1, 0, "x")], feed.S.VIEW), None)
    apply_batch(store, good, 7)
    apply_batch(store, good, 7)
    assert rows(store.view(), "row_key", "payload") == [("1", '{"id":1,"v":"v"}')]
    assert store.latest() == 1 and rows(store.done(), "transaction_id") == [("t0",)]


class Lost(Exception):
    pass


LOSSES = ["before the commit file", "after it", "in the overwrite", "before the move", "before the deletion"]


@pytest.mark.parametrize("step, mode", [*[(s, "meta") for s in LOSSES], ("in the overwrite", "simple")])
def test_a_lost_driver_loses_no_batch(spark, tmp_path, monkeypatch, step, mode):
    """The driver goes at each step of a commit; a new one that gets the batch again ends with the same state."""
    from rowtide.sources import store as module

    store = store_of(spark, tmp_path / "s", mode)
    apply_batch(store, messages(spark, *[insert(i, i) for i in range(6)]), 0)
    second = messages(spark, insert(10, 1, "new"), insert(11, 7), message(12, "gone", 130, [("user", "DELETE", 2, None)]))

    def lose(*_, **__):
        raise Lost

    if step == "before the commit file":
        monkeypatch.setattr(module, "create_file", lose)
    elif step == "after it":
        monkeypatch.setattr(ChangeStore, "publish", lambda self, n=[0]: n.append(1) if len(n) == 1 else lose())
    elif step == "in the overwrite":
        real = ChangeStore._merged

        def some_partitions_gone(self, attempt):
            # The commit of an overwrite deletes and moves folder by folder: leave a view that lost part of itself.
            if len(self._entries()) > 2:
                lost = real(self, attempt).filter("row_key IS NULL").select(*module._PARTS).first()
                module.delete_path(spark, f"{store.root}/view/database_name={lost[0]}/table_name={lost[1]}/bucket={lost[2]}")
                raise Lost
            return real(self, attempt)

        monkeypatch.setattr(ChangeStore, "_merged", some_partitions_gone)
    elif step == "before the move":
        monkeypatch.setattr(module, "move_path", lose)
    else:
        monkeypatch.setattr(module, "delete_path", lambda spark, path: lose() if "/merged/_" in path else None)
    with pytest.raises(Lost):
        apply_batch(store, second, 1)
    monkeypatch.undo()
    keys = ["0", "1", "2", "3", "4", "5", "7"] if mode == "meta" else ["0", "1", "3", "4", "5", "7"]
    other = ChangeStore(spark, store.root, mode)
    if step != "before the commit file":  # committed, so readers see it before anything is repeated
        assert sorted(r[0] for r in rows(other.view(), "row_key")) == keys
    apply_batch(other, second, 1)
    assert sorted(r[0] for r in rows(other.view(), "row_key")) == keys
    assert rows(fold.live(other.view()).filter("row_key = 1"), "payload") == [('{"id":1,"v":"new"}',)]
    assert rows(other.done(), "transaction_id") == sorted([(f"t{i}",) for i in (*range(6), 10, 11)] + [("gone",)], key=str)
    assert other.latest() == 2 and other._unpublished() == []
    apply_batch(other, messages(spark, insert(20, 8)), 2)
    assert len(rows(other.view(), "row_key")) == len(keys) + 1


def test_overlapping_batches_hide_nothing(spark, tmp_path):
    """Of two state batches that overlap one is refused and done again; other writers are never refused."""
    store = store_of(spark, tmp_path / "s")
    one = store.begin("apply", "1")
    two = ChangeStore(spark, store.root).begin("rebuild", "x")
    log = store.begin("capture", "5")
    row = lambda key: spark.createDataFrame([("shop", "user", key, False, "{}", "f.1", 1, 1, 0, "x")], feed.S.VIEW)
    store.commit(log)
    store.commit(two, row("two"))
    with pytest.raises(ConflictError):
        store.commit(one, row("one"))
    assert rows(store.view(), "row_key") == [("two",)]
    again = store.begin("apply", "1")
    store.commit(again, row("one"))
    assert rows(store.view(), "row_key") == [("one",), ("two",)]
    assert store.begin("apply", "1") is None and store.latest() == 3


def test_a_batch_is_begun_again_after_a_rebuild(spark, tmp_path, monkeypatch):
    """A rebuild published while a batch ran: what the batch would have held back is applied."""
    from rowtide.streaming import apply as module

    store = store_of(spark, tmp_path / "s")
    apply_batch(store, messages(spark, insert(0, 1), ddl_message(1, "user", "DROP_COLUMN", 110)), 0)
    spec = TableSpec("shop", "user", ("id", "v"), ("id",), ("id",))
    source = spark.createDataFrame([(1, "rebuilt")], "id bigint, v string")
    real, runs = module._apply, []

    def interrupted(*args):
        view = real(*args)
        if not runs:
            assert run_rebuild(ChangeStore(spark, store.root), "shop.user:mysql-bin.000010:110", spec, source) == "DONE"
        runs.append(1)
        return view

    monkeypatch.setattr(module, "_apply", interrupted)
    apply_batch(store, messages(spark, insert(5, 2, pos=120)), 1)
    assert len(runs) == 2 and store.pending().count() == 0
    assert rows(store.view(), "row_key", "payload") == [("1", '{"id":1,"v":"rebuilt"}'), ("2", '{"id":2,"v":"v"}')]


def test_view_files_do_not_grow_with_batches(spark, tmp_path):
    """Small batches leave one file a bucket, and rewrite only buckets they touch."""
    store = store_of(spark, tmp_path / "s")
    counts, files = [], []
    for i in range(8):
        store.commit(store.begin("apply", str(i)), spark.createDataFrame(
            [("shop", t, str(k), False, str(i), "f.1", 1, i, 0, "x") for t in ("user", "order") for k in (i % 3, 100 + i)], feed.S.VIEW))
        files.append(sorted(store.view().inputFiles()))
        counts.append(len(files[-1]))
    assert max(counts) <= 8 and counts[-1] == counts[-3]
    assert any(set(a) & set(b) for a, b in zip(files, files[1:]))
    assert rows(store.view().filter("table_name = 'user' AND row_key < 3"), "row_key", "payload") == [("0", "6"), ("1", "7"), ("2", "5")]


def test_partitions_of_the_view_do_not_grow_with_tables(spark, tmp_path):
    """Tables share groups: forty of them take no more files than groups and buckets, a rebuilt one loses its rows alone."""
    store = ChangeStore(spark, str(tmp_path / "s"), buckets=2, table_groups=3).create()
    changed = lambda tables, value: spark.createDataFrame(
        [("shop", f"t{t}", str(k), False, value, "f.1", 1, len(value), 0, "x") for t in tables for k in range(2)], feed.S.VIEW)
    store.commit(store.begin("apply", "0"), changed(range(40), "a"))
    other = ChangeStore(spark, store.root)
    other.commit(other.begin("apply", "1"), changed([7], "bb"))
    assert len(other.view().inputFiles()) <= 6
    assert rows(other.view(), "table_name", "row_key", "payload") == sorted(
        (f"t{t}", str(k), "bb" if t == 7 else "a") for t in range(40) for k in range(2))
    table = spark.createDataFrame([("shop", "t8")], "database_name string, table_name string")
    other.commit(other.begin("rebuild", "2"), changed([8], "c").filter("row_key = '1'"), table)
    assert rows(other.view().filter("table_name = 't8'"), "row_key", "payload") == [("1", "c")]
    assert other.view().count() == 79


def fragments(arrival, txn_id, pos, parts, start=0):
    """Messages of a transaction cut into the given parts, one arrival each."""
    out = []
    for k, events in enumerate(parts):
        topic, partition, at, key, _, value = message(arrival + k, txn_id, pos, events)
        body = json.loads(value)
        body["transaction"] |= {"fragment": k, "fragments": len(parts)}
        out.append((topic, partition, at, key, k, json.dumps(body)))
    return out


def test_parts_in_different_batches_are_one_transaction(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    event = lambda key, table="user": (table, "INSERT", key, {"id": key})
    good = fragments(0, "good", 100, [[event(0), event(1)], [event(2), event(3)], [event(4)]])
    bad = fragments(10, "bad", 200, [[event(10)], [event(11), ("user", "NONE", 12, None)]])
    blocked = fragments(30, "blocked", 400, [[event(20)], [event(21, "order")]])
    apply_batch(store, messages(spark, good[0], bad[0]), 0, on_reject="quarantine")
    assert store.view().count() == 0 and store.done().count() == 0
    apply_batch(store, messages(spark, good[2], ddl_message(20, "order", "DROP_COLUMN", 300), blocked[0]), 1, on_reject="quarantine")
    assert store.view().count() == 0
    apply_batch(store, messages(spark, good[1], bad[1], blocked[1]), 2, on_reject="quarantine")
    assert rows(store.view(), "row_key") == [(str(k),) for k in range(5)]
    assert rows(store.done(), "transaction_id") == [("good",)]
    assert {r.reason for r in store.read("quarantine").collect()} == {"eventType"}
    assert rows(store.pending(), "transaction_id", "fragment") == [("blocked", 0), ("blocked", 1)]
    # A part delivered again after its transaction was applied waits for nothing and changes nothing.
    apply_batch(store, messages(spark, *[(t, p, a + 100, k, f, v) for t, p, a, k, f, v in good[:1]]), 3, on_reject="quarantine")
    assert store.read("held", only=store.latest("apply")).count() == 0
    assert rows(store.view(), "row_key") == [(str(k),) for k in range(5)]


def test_scratch_scopes_belong_to_their_thread(spark):
    import threading

    from rowtide.session import materialize, path_exists, scratch_path, scratch_scope

    started, release, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch_scope(spark):
            df = materialize(spark.range(3), "mine")
            started.set()
            release.wait(60)
            seen.append(df.count())

    thread = threading.Thread(target=other)
    with scratch_scope(spark):
        thread.start()
        started.wait(60)
        path = scratch_path(spark, "gone")
        spark.range(1).write.parquet(path)
    assert not path_exists(spark, path)
    release.set()
    thread.join()
    assert seen == [3]


def test_scenarios_of_version_guard(spark, tmp_path):
    alice, alicia = '{"username":"alice"}', '{"username":"alicia"}'
    # key: arrivals of (transaction, position, operation), expected payload, deleted, position
    cases = {
        1: ([(125, "INSERT", alice)], alice, False, 125),
        2: ([(126, "DELETE", None)], None, True, 126),
        3: ([(126, "DELETE", None), (125, "INSERT", alice)], None, True, 126),
        4: ([(125, "INSERT", alice), (126, "UPDATE", alicia), (124, "DELETE", None)], alicia, False, 126),
        5: ([(125, "SNAPSHOT_UPSERT", alice)], alice, False, 125),
        6: ([(125, "INSERT", alice), (125, "UPDATE", alicia)], alice, False, 125),
    }
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    for step in range(3):
        batch = [
            message(step, f"t{key}-{step}", listed[step][0], [("user", listed[step][1], key, json.loads(listed[step][2] or "null"))])
            for key, (listed, *_) in cases.items()
            if step < len(listed)
        ]
        apply_batch(store, messages(spark, *[(*m[:2], 100 * step + i, *m[3:]) for i, m in enumerate(batch)]), step)
    got = {r.row_key: (r.payload, r.deleted, r.next_position) for r in store.view().collect()}
    assert got == {str(key): tuple(expected) for key, (_, *expected) in cases.items()}


def test_poison_and_rejects(spark, tmp_path):
    good = message(0, "a", 125, [("user", "INSERT", 1, {"id": 1})])
    bad = ("t", 0, 1, "k", 0, "not-json")
    no_image = message(2, "b", 126, [("user", "INSERT", 2, None), ("user", "INSERT", 3, {"id": 3})])
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    with pytest.raises(PoisonMessageError):
        apply_batch(store, messages(spark, good, bad), 0)
    with pytest.raises(RejectedTransactionError):
        apply_batch(store, messages(spark, good, no_image), 0)
    assert store.latest() == 0
    apply_batch(store, messages(spark, good, bad, no_image), 0, on_poison="quarantine", on_reject="quarantine")
    assert rows(store.read("quarantine"), "key", "reason") == [("b", "after"), ("k", "MALFORMED")]
    assert rows(store.view(), "row_key") == [("1",)]


def test_poison_is_not_retried_and_other_failures_are(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "topic")
    write_envelopes(messages(spark, ("t", 0, 0, "k", 0, "not-json")), source)
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    stream = read_envelopes(spark, source, stream=True)
    with pytest.raises(StreamingQueryException):
        run_sync(stream, store, str(tmp_path / "cp"), backoff_seconds=0)

    calls = []
    from rowtide.streaming import apply as module

    def flaky(*args, **kwargs):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("store down")
        return apply_batch(*args, **kwargs)

    monkeypatch.setattr(module, "apply_batch", flaky)
    used = run_sync(stream, store, str(tmp_path / "cp"), backoff_seconds=0, on_poison="quarantine")
    assert used == 3 and len(calls) == 3


def test_timeline_of_schema_changes_and_rebuild(spark, tmp_path):
    """Changes on one table hold back transactions that touch it, whole, until it is rebuilt."""
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    one = lambda key, v: {"id": key, "v": v}
    apply_batch(
        store,
        messages(
            spark,
            message(0, "t9", 9, [("user", "INSERT", 1, one(1, "old"))]),
            ddl_message(1, "user", "DROP_COLUMN", 10),
            message(2, "t12", 12, [("order", "UPDATE", 5, one(5, "x"))]),
            message(3, "t13", 13, [("user", "UPDATE", 1, one(1, "new"))]),
            message(4, "t14", 14, [("user", "INSERT", 2, one(2, "n")), ("order", "INSERT", 6, one(6, "y"))]),
        ),
        0,
    )
    apply_batch(
        store,
        messages(
            spark,
            ddl_message(5, "user", "DROP_COLUMN", 15),
            message(6, "t16", 16, [("order", "INSERT", 7, one(7, "z"))]),
            message(7, "t17", 17, [("user", "INSERT", 3, one(3, "w"))]),
            ddl_message(8, "user", "ADD_COLUMN", 18),
        ),
        1,
    )
    assert rows(store.pending(), "transaction_id", "blocked_position", "status") == [
        ("t13", 10, "PENDING"), ("t14", 10, "PENDING"), ("t17", 15, "PENDING")]
    assert rows(store.schema_states(), "table_name", "status", "next_position") == [("user", "REBUILD_REQUIRED", 15)]
    assert rows(store.view(), "table_name", "row_key") == [("order", "5"), ("order", "7"), ("user", "1")]

    spec = TableSpec("shop", "user", ("id", "v"), ("id",), ("id",))
    source = spark.createDataFrame([(1, "rebuilt"), (4, "four")], "id bigint, v string")
    assert run_rebuild(store, "shop.user:mysql-bin.000010:10", spec, source) == "OBSOLETE"
    assert run_rebuild(store, "shop.user:mysql-bin.000010:10", spec, source) == "OBSOLETE"
    broken = source.select("id", F.raise_error(F.lit("source gone")).cast("string").alias("v"))
    task = "shop.user:mysql-bin.000010:15"
    assert run_rebuild(store, task, spec, broken, max_retries=2) == "PENDING"
    assert rows(store.schema_states(), "status") == [("REBUILD_REQUIRED",)]
    assert run_rebuild(store, task, spec, source, max_retries=2) == "DONE"
    # Rows of the re-read table carry the change's position 15, so t13 cannot override
    # user 1. Users 2 and 3 were not in the re-read table and come from the replay.
    state = rows(store.view(), "table_name", "row_key", "payload")
    assert state == [
        ("order", "5", '{"id":5,"v":"x"}'),
        ("order", "6", '{"id":6,"v":"y"}'),
        ("order", "7", '{"id":7,"v":"z"}'),
        ("user", "1", '{"id":1,"v":"rebuilt"}'),
        ("user", "2", '{"id":2,"v":"n"}'),
        ("user", "3", '{"id":3,"v":"w"}'),
        ("user", "4", '{"id":4,"v":"four"}'),
    ]
    assert rows(store.pending().filter("status = 'PENDING'"), "transaction_id") == []
    assert rows(store.schema_states(), "status") == [("ACTIVE",)]
    assert rows(store.tasks(), "next_position", "status", "retry_count") == [(10, "OBSOLETE", 0), (15, "DONE", 1)]
    # Redelivery of a replayed transaction is a duplicate now.
    apply_batch(store, messages(spark, message(9, "t17", 17, [("user", "INSERT", 3, one(3, "w"))])), 2)
    assert rows(store.view(), "table_name", "row_key", "payload") == state


def test_rebuild_gives_up(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    apply_batch(store, messages(spark, ddl_message(1, "user", "DROP_COLUMN", 10)), 0)
    spec = TableSpec("shop", "user", ("id", "v"), ("id",), ("id",))
    broken = spark.range(1).select("id", F.raise_error(F.lit("gone")).cast("string").alias("v"))
    task = "shop.user:mysql-bin.000010:10"
    assert [run_rebuild(store, task, spec, broken) for _ in range(3)] == ["PENDING", "PENDING", "FAILED"]
    assert rows(store.schema_states(), "status") == [("REBUILD_FAILED",)]
    assert store.tasks().first().retry_count == 3


def test_capture_stream_equals_batch(spark, sf, tmp_path):
    raw = feed.raw_log(spark, sf)
    catalog = feed.catalog(spark)
    source = str(tmp_path / "log")
    # Log files appear one after the other, cut in the middle of transactions.
    for low, high in ((0, 9_035), (9_035, 1 << 40)):
        raw.filter((F.col("pos") > low) & (F.col("pos") <= high)).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    stream = stream_change_log(spark, source, max_files=1)
    writer = capture_stream(stream, store, catalog, blocks=Blocks(span=4096), on_pk_change="quarantine")
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    changes, _ = assemble.assemble_changes(assemble.commit_groups(raw, catalog), catalog, "quarantine")
    good, _ = envelope.decode_envelopes(store.read("messages").drop("version"))
    ddl_rows, txns, _ = envelope.split_messages(good)
    columns = ["transaction_id", "event_index", "table_name", "op", "before", "after"]
    assert rows(envelope.explode_rows(txns), *columns) == rows(changes, *columns)
    from rowtide.operators.ddl import schema_change_events

    assert rows(ddl_rows, "event_id") == rows(schema_change_events(raw, catalog), "event_id")
    got = [r.arrival for r in store.read("messages").orderBy("arrival").collect()]
    assert got == sorted(set(got))
    whole = assemble.advance_checkpoint(assemble.commits(assemble.commit_groups(raw, catalog)), None)
    assert rows(store.checkpoints(), "file", "position") == rows(whole, "file", "position")

    # The captured messages feed the second job.
    assert run_sync(read_envelopes(spark, f"{store.root}/messages", stream=True), store, str(tmp_path / "cp2"),
                    on_reject="quarantine") == 1
    assert store.view().count() > 0


def test_open_transaction_waits_for_its_commit(spark, tmp_path):
    schema = spark.createDataFrame([], feed.S.RAW).schema
    def event(pos, kind, **kw):
        base = {"connector": "c", "file": "mysql-bin.000001", "pos": pos, "seq": 0, "type": kind, "table_id": None,
                "database_name": None, "table_name": None, "rows": None, "xid": None, "sql": None, "ts_ms": 1}
        return {**base, **kw}
    first = [event(10, "TABLE_MAP", table_id=10, database_name="shop", table_name="user"),
             event(20, "WRITE", table_id=10, rows=[{"before": None, "after": ["1", "7", "p", "k"]}])]
    second = [event(30, "WRITE", table_id=10, rows=[{"before": None, "after": ["2", "8", "p", "k"]}]),
              event(240, "XID", xid=345)]
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    capture_batch(store, spark.createDataFrame(first, schema), 0, feed.catalog(spark))
    assert store.read("messages").count() == 0 and store.checkpoints().count() == 0
    capture_batch(store, spark.createDataFrame(second, schema), 1, feed.catalog(spark))
    [sent] = store.read("messages").collect()
    assert sent.key == "c:mysql-bin.000001:345:240"
    events = json.loads(sent.value)["transaction"]["events"]
    assert [(e["eventIndex"], e["primaryKey"], e["after"]["cents"]) for e in events] == [(0, {"id": 1}, 7), (1, {"id": 2}, 8)]
    assert rows(store.checkpoints(), "file", "position") == [("mysql-bin.000001", 240)]


def test_rows_are_named_by_the_columns_of_their_position(spark, tmp_path):
    """A schema change names the rows behind it, in its own batch, in a transaction it interrupts and in later batches."""
    schema = spark.createDataFrame([], feed.S.RAW).schema

    def event(pos, kind, file=1, **kw):
        base = {"connector": "c", "file": f"mysql-bin.{file:06}", "pos": pos, "seq": 0, "type": kind, "table_id": None,
                "database_name": None, "table_name": None, "rows": None, "xid": None, "sql": None, "ts_ms": 1}
        return {**base, **kw}

    def write(pos, *values, file=1):
        return event(pos, "WRITE", file, table_id=10, rows=[{"before": None, "after": list(values)}])

    table_map = lambda pos, file=1: event(pos, "TABLE_MAP", file, table_id=10, database_name="shop", table_name="user")
    query = lambda pos, sql, file=1: event(pos, "QUERY", file, database_name="shop", sql=sql)
    batches = [
        [table_map(10), write(20, "1", "7", "p", "k"), event(30, "XID", xid=1), query(40, "ALTER TABLE user ADD COLUMN age int AFTER id"),
         table_map(50), write(60, "2", "33", "8", "p", "k"), event(70, "XID", xid=2), write(80, "3", "34", "9", "p", "k")],
        [event(90, "XID", xid=3), query(100, "alter table shop.user drop column props, rename column kind to sort"), table_map(110),
         write(120, "4", "35", "10", "s"), event(130, "XID", xid=4)],
        [table_map(5, 2), write(10, "5", "36", "11", "s", file=2), event(20, "XID", 2, xid=5)],
    ]
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    for i, listed in enumerate(batches):
        capture_batch(store, spark.createDataFrame(listed, schema), i, feed.catalog(spark))
    after = {}
    for m in store.read("messages").collect():
        body = json.loads(m.value)
        if body["messageType"] == "TRANSACTION":
            after[body["transaction"]["xid"]] = body["transaction"]["events"][0]["after"]
    assert after == {
        1: {"id": 1, "cents": 7, "props": "p", "kind": "k"},
        2: {"id": 2, "age": 33, "cents": 8, "props": "p", "kind": "k"},
        3: {"id": 3, "age": 34, "cents": 9, "props": "p", "kind": "k"},
        4: {"id": 4, "age": 35, "cents": 10, "sort": "s"},
        5: {"id": 5, "age": 36, "cents": 11, "sort": "s"},
    }
    assert rows(store.read("layouts"), "position", "columns") == [
        (100, ["id", "age", "cents", "sort"]), (40, ["id", "age", "cents", "props", "kind"])]


def test_repeats_inside_the_horizon_are_dropped(spark, tmp_path):
    """Repeats in later batches go while the horizon lasts; after it the done set still knows them."""
    source, minute = str(tmp_path / "topic"), "timestamp_seconds(1000000 + arrival * 60)"

    def run(*listed):
        write_envelopes(messages(spark, *listed).coalesce(1), source)
        stream = read_envelopes(spark, source, stream=True)
        kept = drop_repeats(stream, "10 minutes", F.expr(minute)).writeStream.format("parquet").option("path", str(tmp_path / "once"))
        kept.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [(r.arrival, r.key) for r in spark.read.parquet(str(tmp_path / "once")).orderBy("arrival").collect()]

    again = lambda m, at: (m[0], m[1], at, *m[3:])
    one, none = insert(0, 1), ("t", 0, 1, None, 0, "x")
    other = (*insert(0, 2)[:3], "t0", *insert(0, 2)[4:])
    assert run(one, none) == [(0, "t0"), (1, None)]
    assert run(again(one, 5), again(none, 6), again(other, 7)) == [(0, "t0"), (1, None), (6, None), (7, "t0")]
    run(insert(40, 3))
    assert run(again(one, 45))[-1] == (45, "t0")
    store = store_of(spark, tmp_path / "s")
    assert run_sync(read_envelopes(spark, source, stream=True), store, str(tmp_path / "cp2"), horizon="1 hour", on_poison="quarantine") == 1
    assert rows(store.done(), "transaction_id") == [("t0",), ("t40",)]


def test_bootstrap_publishes_pages_and_one_checkpoint(spark, tmp_path):
    from rowtide.operators.snapshot import Cutover, SnapshotTable

    cutover = Cutover("c", "mysql-bin.000321", 678)
    user, order = (TableSpec("shop", t, ("id", "v"), ("id",), ("id",)) for t in ("user", "order"))
    data = lambda n: spark.range(1, n + 1).select("id", F.lit("x").alias("v"))
    tables = [SnapshotTable(user, data(30)), SnapshotTable(order, data(25))]
    store = ChangeStore(spark, str(tmp_path / "s")).create()
    broken = data(1).select("id", F.raise_error(F.lit("kafka down")).cast("string").alias("v"))
    with pytest.raises(Exception, match="kafka down"):
        run_bootstrap(store, [tables[0], SnapshotTable(order, broken)], cutover, 10)
    failed = rows(store.full_sync_tasks(), "table_name", "status", "last_sent_pk")
    assert failed == [("order", "FAILED", None), ("user", "COMPLETED", '{"id":30}')]
    assert "kafka down" in store.full_sync_tasks().filter("table_name = 'order'").first().last_error
    assert store.checkpoints().count() == 0

    run_bootstrap(store, tables, cutover, 10)
    assert rows(store.full_sync_tasks(), "table_name", "status", "last_sent_pk") == [
        ("order", "COMPLETED", '{"id":25}'), ("user", "COMPLETED", '{"id":30}')]
    assert rows(store.checkpoints(), "file", "position") == [("mysql-bin.000321", 678)]
    sent = store.read("messages").orderBy("arrival").collect()
    assert [m.key.split(":")[2] for m in sent] == ["shop.user"] * 6 + ["shop.order"] * 3
    apply_batch(store, store.read("messages").drop("version"), 0)
    assert rows(fold.live(store.view()).groupBy("table_name").count(), "table_name", "count") == [("order", 25), ("user", 30)]
    page = store.overview()
    assert {name: df.count() > 0 for name, df in page.items()} == {
        "checkpoint": True, "full_sync_tasks": True, "rebuild_summary": True, "schema_states": False, "recent_events": True}


def at(row, partition, offset):
    return (row[0], partition, offset, *row[3:])


@pytest.mark.parametrize("mode", ["meta", "simple"])
def test_partitions_lead_to_the_state_of_one(spark, tmp_path, mode):
    log = [insert(i, i % 3, f"v{i}", pos=100 * (i + 1), table="user" if i % 2 else "order") for i in range(8)]
    log[3] = ddl_message(3, "user", "DROP_COLUMN", 400)
    log += fragments(8, "t8", 900, [[("order", "UPDATE", 0, {"id": 0, "v": "a"})], [("order", "UPDATE", 0, {"id": 0, "v": "b"})]])
    log[9] = (*log[9][:5], log[9][5].replace('"eventIndex": 0', '"eventIndex": 1'))
    one = store_of(spark, tmp_path / "one", mode)
    apply_batch(one, messages(spark, *log), 0)

    # Three partitions that all count from 0; the schema change lies in the last, which comes late.
    home = [0, 1, 0, 2, 1, 0, 1, 0, 1, 1]
    spread = [at(row, p, home[:i].count(p)) for i, (row, p) in enumerate(zip(log, home))]
    first = [row for row, p in zip(spread, home) if p < 2]
    store = store_of(spark, tmp_path / "many", mode)
    policy = {"partitions": [0, 1, 2], "on_poison": "quarantine"}
    apply_batch(store, messages(spark, *first, ("t", 0, 99, "k", 0, "{broken")), 0, **policy)
    assert store.view().isEmpty() and store.done().isEmpty()
    assert rows(store.read("quarantine"), "arrival", "reason") == [(99, "MALFORMED")]
    # Repeats of what waits, then the late partition: it has come to position 400.
    apply_batch(store, messages(spark, *first[:3]), 1, **policy)
    apply_batch(store, messages(spark, *[row for row, p in zip(spread, home) if p == 2]), 2, **policy)
    assert rows(store.done(), "transaction_id") == [("t0",), ("t1",), ("t2",)]
    release_waiting(store, "end", [0, 1, 2])
    release_waiting(store, "end", [0, 1, 2])
    assert view_rows(store.view()) == view_rows(one.view())
    assert rows(store.done(), "transaction_id") == rows(one.done(), "transaction_id")
    assert rows(store.pending(), "transaction_id", "blocked_position") == rows(one.pending(), "transaction_id", "blocked_position")
    assert store.read("held", only=store.latest("apply")).isEmpty()


def test_places_frontiers_and_messages_without_a_place(spark):
    listed = messages(
        spark, at(insert(0, 1, pos=500), 0, 7), at(insert(1, 1, pos=200), 1, 7), ("t", 1, 8, "k", 0, None),
        at(ddl_message(2, "user", "ADD_COLUMN", 300), 0, 8), at(message(3, "t3", 900, []), 1, 9),
        at(message(4, "t4", 100, [], file="mysql-bin.000011"), 2, 1),
    )
    placed = partitions.with_place(envelope.parse_messages(listed)).cache()
    stored = spark.createDataFrame([(1, 0), (0, 1 << 60)], "partition int, place bigint")
    seen = partitions.frontiers(placed, stored)
    base = 10 << partitions.POSITION_BITS
    assert rows(seen, "partition", "place") == [(0, 1 << 60), (1, base + 900), (2, (11 << partitions.POSITION_BITS) + 100)]
    assert partitions.reached(seen, [0, 1, 2]) == base + 900 and partitions.reached(seen, [0, 3]) == -1
    ready, ahead = partitions.split_ahead(placed, base + 300)
    assert rows(ready, "key") == [("ddl:mysql-bin.000010:300",), ("k",), ("t1",)]
    assert rows(ahead, "key") == [("t0",), ("t3",), ("t4",)]
    nothing = placed.filter("false")
    assert partitions.frontiers(nothing, stored.filter("false")).isEmpty() and partitions.split_ahead(nothing, None)[0].isEmpty()


@pytest.mark.parametrize("mode", ["meta", "simple"])
def test_the_first_changes_of_a_store_are_not_merged(spark, tmp_path, monkeypatch, mode):
    store, merges, real = store_of(spark, tmp_path / "s", mode), [], fold.merge_rows
    monkeypatch.setattr(fold, "merge_rows", lambda *a, **k: merges.append(1) or real(*a, **k))
    gone = message(1, "gone", 130, [("user", "DELETE", 2, None)])
    apply_batch(store, messages(spark, insert(0, 1), gone), 0)
    assert not merges
    expected = {("1", False), ("2", True)} if mode == "meta" else {("1", False)}
    assert set(rows(store.view(), "row_key", "deleted")) == expected
    apply_batch(store, messages(spark, message(9, "late", 900, [("user", "DELETE", 1, None)]), insert(10, 3)), 1)
    assert merges
    expected = {("1", True), ("2", True), ("3", False)} if mode == "meta" else {("3", False)}
    assert set(rows(store.view(), "row_key", "deleted")) == expected


def test_tables_nobody_wrote_cost_no_scan(spark, tmp_path):
    store = store_of(spark, tmp_path / "s")
    joined = spark.range(3).selectExpr("string(id) AS transaction_id").join(store.done(), "transaction_id", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and "Join" not in plan and "ExistingRDD" not in plan and joined.count() == 0


def test_a_batch_is_asked_once_what_it_holds(spark, tmp_path, monkeypatch):
    """Nothing is looked for again that the batch does not hold; what it holds is judged as before."""
    judged, real = [], envelope.validate_transactions
    monkeypatch.setattr(envelope, "validate_transactions", lambda t: judged.append(1) or real(t))
    store = store_of(spark, tmp_path / "s")
    apply_batch(store, messages(spark, insert(0, 1)), 0, on_poison="quarantine", on_reject="quarantine")
    assert not judged and store.read("quarantine").count() == 0
    bad = message(3, "bad", 300, [("user", "INSERT", 5, None)])
    apply_batch(store, messages(spark, insert(1, 2), ("t", 0, 2, "k", 0, "{"), bad), 1, on_poison="quarantine", on_reject="quarantine")
    assert judged and rows(store.read("quarantine"), "arrival", "reason") == [(2, "MALFORMED"), (3, "after")]
    assert rows(store.outcomes(), "reference", "result") == [("bad", "FAILED"), ("t0", "SUCCESS"), ("t1", "SUCCESS")]
