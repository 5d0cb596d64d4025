"""Synced state: Parquet tables whose batches count once their commit file exists, and a merged view.

A batch writes its rows into folders of its own attempt and is committed by one file, created atomically with the
next number. Until then nobody reads its folders, afterwards everybody does; there is no state between. A batch of
the state (``apply``, ``rebuild``) is refused when another one was committed since it began, and is done again.

The view is Parquet partitioned by database, table and bucket of the row key, in a store of very many tables by group
of tables and bucket. A batch merges its changes into the
buckets they touch, keeps the result with its attempt, commits, and then overwrites just those partitions (Spark's
dynamic partition overwrite). Should the driver be lost on the way, the kept result is read in their place until the
next batch has repeated the overwrite.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide import schemas as S
from rowtide.operators import fold, ops
from rowtide.operators.ddl import schema_state
from rowtide.session import (
    ROW_GROUPS,
    create_file,
    delete_path,
    empty_frame,
    list_names,
    move_path,
    path_exists,
    read_file,
)

_TABLE = ["database_name", "table_name"]

TABLES = {
    "done": "transaction_id string, file_seq bigint",
    "pending": S.PENDING,
    "replayed": "transaction_id string",
    "schema_changes": S.SCHEMA_CHANGE,
    "status_log": "database_name string, table_name string, file_seq bigint, next_position bigint, status string",
    "tasks": S.REBUILD_TASK,
    "outcomes": S.OUTCOME,
    "held": "arrival bigint, key string, fragment int, value string",
    "frontiers": "partition int, place bigint",
    "quarantine": "arrival bigint, key string, value string, reason string",
    "messages": S.MESSAGES,
    "tail": S.RAW,
    "layouts": S.LAYOUT,
    "checkpoints": S.CHECKPOINT,
    "full_sync": S.FULL_SYNC_TASK,
}
_PARTS = [*_TABLE, "bucket"]
_GROUPED_PARTS = ["table_group", "bucket"]
# Writers whose batches build on each other; a batch of one is refused when a batch of its group came between.
_GROUPS = {"apply": "state", "rebuild": "state", "capture": "log", "snapshot": "log"}


class ConflictError(RuntimeError):
    """Another batch was committed since this one began; begin again."""


class Batch(NamedTuple):
    """One attempt at a batch: the newest commit it builds on, and the folder its rows go to."""

    writer: str
    name: str
    base: int
    attempt: str

    @property
    def version(self) -> int:
        """Orders the rows of writers that build on each other."""
        return self.base + 1


class ChangeStore:
    """A folder of tables. ``mode`` is ``meta`` (version guard) or ``simple`` (arrival order).

    ``buckets`` divides each table of the view. A batch rewrites the buckets its keys fall into, so take enough of
    them that one bucket is some 100 MB; the number is fixed when the store is created. ``table_groups`` lets tables
    share that many groups of buckets, so that the partitions of the view are counted by configuration and not by
    tables; by default every table has buckets of its own, which is for some hundred tables. Also fixed at creation.
    """

    def __init__(
        self, spark: SparkSession, root: str, mode: str = "meta", buckets: int = 16, table_groups: int | None = None
    ):
        if mode not in ("meta", "simple"):
            raise ValueError(f"unknown apply mode: {mode}")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        self.buckets, self.table_groups = buckets, table_groups
        self._seen: dict[int, dict] = {}

    def create(self) -> ChangeStore:
        """Start the commit log; tables appear with the first batch that writes them."""
        self.commit(Batch("create", "0", -1, "none"))
        return self

    # --- commits ----------------------------------------------------------------------------

    def _entries(self) -> dict[int, dict]:
        """The commit log by number. Entries never change, so only new ones are opened."""
        for name in list_names(self.spark, f"{self.root}/commits"):
            if int(name) not in self._seen:
                self._seen[int(name)] = json.loads(read_file(self.spark, f"{self.root}/commits/{name}"))
        if 0 in self._seen:
            self.buckets, self.table_groups = self._seen[0]["buckets"], self._seen[0].get("table_groups")
        return self._seen

    def latest(self, writer: str | None = None) -> int:
        """Number of the newest commit, of one writer if given; -1 when there is none."""
        return max((n for n, e in self._entries().items() if writer in (None, e["writer"])), default=-1)

    def begin(self, writer: str, name: str) -> Batch | None:
        """A new attempt at a batch, None when the batch is committed already."""
        entries = self._entries()
        self.publish()
        if any((e["writer"], e["batch"]) == (writer, name) for e in entries.values()):
            return None
        return Batch(writer, name, max(entries, default=-1), uuid.uuid4().hex[:16])

    def commit(self, batch: Batch, view: DataFrame | None = None, replaced: DataFrame | None = None) -> None:
        """Make a batch count, with the changes it makes to the view.

        ``view`` holds folded changes, one row a key, to be merged; tables listed in ``replaced`` lose their old rows.
        """
        if view is not None:
            self._write_merged(batch, view, replaced)
        group = _GROUPS.get(batch.writer, batch.writer)
        entry = {"writer": batch.writer, "batch": batch.name, "attempt": batch.attempt, "view": view is not None,
                 "buckets": self.buckets, "table_groups": self.table_groups}
        while True:
            entries = self._entries()
            newer = [e for n, e in entries.items() if n > batch.base]
            if any(_GROUPS.get(e["writer"], e["writer"]) == group for e in newer):
                raise ConflictError(f"{batch.writer} {batch.name}: another {group} batch was committed meanwhile")
            if create_file(self.spark, f"{self.root}/commits/{max(entries, default=-1) + 1}", json.dumps(entry)):
                break
        self.publish()

    def discard(self, batch: Batch) -> None:
        """Remove the rows of an attempt that was not committed; nobody reads them, they only take room."""
        for name in TABLES:
            delete_path(self.spark, f"{self.root}/{name}/version={batch.version}/attempt={batch.attempt}")
        delete_path(self.spark, f"{self.root}/merged/{batch.attempt}")

    # --- tables -----------------------------------------------------------------------------

    def write(self, name: str, batch: Batch, df: DataFrame) -> None:
        """Write one table of a batch; not visible before the batch is committed."""
        columns = T.StructType.fromDDL(TABLES[name]).names
        path = f"{self.root}/{name}/version={batch.version}/attempt={batch.attempt}"
        df.select(*columns).write.mode("overwrite").options(**ROW_GROUPS).parquet(path)

    @staticmethod
    def first_arrival(batch: Batch) -> int:
        """First arrival number of a batch's messages: each has room for 2**31."""
        return batch.version << 31

    def read(self, name: str, upto: int | None = None, only: int | None = None) -> DataFrame:
        """Rows of committed batches with their ``version``: of all, of those up to a commit, or of one commit."""
        schema = f"{TABLES[name]}, version bigint, attempt string"
        columns = [c for c in T.StructType.fromDDL(schema).names if c != "attempt"]
        if not path_exists(self.spark, f"{self.root}/{name}"):
            return empty_frame(self.spark, schema).select(*columns)
        listed = [
            e["attempt"] for n, e in sorted(self._entries().items())
            if (only is None or n == only) and (upto is None or n <= upto)
        ]
        # Folder names are partition values, so folders of other attempts are not opened.
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return rows.filter(F.col("attempt").isin(listed)).select(*columns)

    # --- view -------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("row_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _table_part(self) -> list[str | Column]:
        """What tells the tables' partitions apart: their names, or the group they share."""
        if self.table_groups is None:
            return _TABLE
        return [F.pmod(F.xxhash64(*_TABLE), F.lit(self.table_groups)).cast("int").alias("table_group")]

    def _parts(self) -> list[str]:
        return _PARTS if self.table_groups is None else _GROUPED_PARTS

    def _view_schema(self) -> str:
        added = [c for c in self._parts() if c not in S.VIEW_COLUMNS]
        return ", ".join([S.VIEW, *[f"{c} int" for c in added]])

    def _place(self) -> Column:
        return F.concat_ws("/", *self._parts())

    def has_view(self) -> bool:
        """Whether a batch has written rows of the view yet."""
        return path_exists(self.spark, f"{self.root}/view")

    def _stored(self) -> DataFrame:
        """The view as its partitions hold it, with a row without a key in each that a later batch has written."""
        if not self.has_view():
            return empty_frame(self.spark, self._view_schema())
        return self.spark.read.schema(self._view_schema()).parquet(f"{self.root}/view")

    def _unpublished(self) -> list[str]:
        """Attempts committed with a merged result that has not replaced its partitions yet; one at most."""
        kept = set(list_names(self.spark, f"{self.root}/merged"))
        return [e["attempt"] for _, e in sorted(self._entries().items()) if e["attempt"] in kept]

    def _merged(self, attempt: str) -> DataFrame:
        return self.spark.read.schema(self._view_schema()).parquet(f"{self.root}/merged/{attempt}")

    def _write_merged(self, batch: Batch, view: DataFrame, replaced: DataFrame | None) -> None:
        """Keep the new content of every touched bucket."""
        parts = self._parts()
        others = [c for c in S.VIEW_COLUMNS if c not in parts]
        incoming = view.select(*others, *self._table_part(), self._bucket())
        if replaced is None and not self.has_view():
            # The folded changes are the view, and no bucket is there that could lose its rows.
            rows = fold.live(incoming) if self.mode == "simple" else incoming
            rows.write.mode("overwrite").parquet(f"{self.root}/merged/{batch.attempt}")
            return
        places = incoming.select(*parts).distinct()
        if replaced is not None:
            every = F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket")
            places = places.unionByName(replaced.select(*self._table_part(), every)).distinct()
        # Bounded by configuration: tables, or their groups, times buckets.
        places = self.spark.createDataFrame(places.toArrow(), places.schema)
        touched = [r[0] for r in places.select(self._place()).collect()]
        stored = self._stored().filter(self._place().isin(touched) & F.col("row_key").isNotNull())
        if replaced is not None:
            stored = stored.join(F.broadcast(replaced.select(*_TABLE).distinct()), _TABLE, "left_anti")
        # One exchange by bucket serves the merge and the files.
        both = stored.withColumn("_stored", F.lit(1)).unionByName(incoming.withColumn("_stored", F.lit(0)))
        rows = fold.merge_rows(both.repartition(*parts), by=parts, guarded=self.mode == "meta")
        if self.mode == "simple":
            rows = fold.live(rows)
        empty = places.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in parts else F.col(f.name)
                                for f in T.StructType.fromDDL(self._view_schema())])
        # A row without a key stands for the bucket, so that one which lost all its rows is overwritten too.
        rows.unionByName(empty).write.mode("overwrite").parquet(f"{self.root}/merged/{batch.attempt}")

    def publish(self) -> None:
        """Overwrite the partitions of the view that a committed batch has merged; may be repeated."""
        for attempt in self._unpublished():
            self._merged(attempt).repartition(*self._parts()).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(*self._parts()).parquet(f"{self.root}/view")
            # Moved away in one step before it is deleted, so that half of it is never taken for the whole.
            move_path(self.spark, f"{self.root}/merged/{attempt}", f"{self.root}/merged/_{attempt}")
            delete_path(self.spark, f"{self.root}/merged/_{attempt}")

    def view(self) -> DataFrame:
        """Latest state per key, tombstones included in ``meta`` mode."""
        rows = self._stored()
        for attempt in self._unpublished():
            merged = self._merged(attempt)
            touched = [r[0] for r in merged.select(self._place()).distinct().collect()]
            rows = rows.filter(~self._place().isin(touched)).unionByName(merged)
        return rows.filter("row_key IS NOT NULL").select(*S.VIEW_COLUMNS)

    # --- current state ----------------------------------------------------------------------

    def done(self, file_range: tuple[int, int] | None = None, upto: int | None = None) -> DataFrame:
        """Applied transaction ids; a range of log files lets the scan skip all others."""
        rows = self.read("done", upto)
        if file_range:
            rows = rows.filter(F.col("file_seq").between(*file_range))
        return rows.select("transaction_id")

    def schema_states(self, upto: int | None = None) -> DataFrame:
        log = self.read("status_log", upto).withColumnRenamed("version", "seq")
        return schema_state(self.read("schema_changes", upto), log)

    def tasks(self) -> DataFrame:
        """Newest row per rebuild task."""
        rows = self.read("tasks")
        columns = [c for c in rows.columns if c not in ("task_id", "version")]
        newest = F.max_by(F.struct(*columns), F.struct("version", "updated_at"))
        return rows.groupBy("task_id").agg(newest.alias("_t")).select("task_id", "_t.*")

    def pending(self) -> DataFrame:
        """Buffered messages with their status."""
        replayed = self.read("replayed").select("transaction_id", F.lit(True).alias("_r")).distinct()
        joined = self.read("pending").drop("version").join(replayed, "transaction_id", "left")
        status = F.when(F.col("_r"), F.lit("REPLAYED")).otherwise(F.col("status"))
        return joined.withColumn("status", status).drop("_r")

    def checkpoints(self) -> DataFrame:
        """Newest checkpoint per connector."""
        rows = self.read("checkpoints")
        newest = F.max_by(F.struct("file", "file_seq", "position"), "version")
        return rows.groupBy("connector").agg(newest.alias("p")).select("connector", "p.*")

    def full_sync_tasks(self) -> DataFrame:
        """Newest progress row per connector and table."""
        rows = self.read("full_sync")
        keys = ["connector", *_TABLE]
        columns = [c for c in rows.columns if c not in (*keys, "version")]
        newest = F.max_by(F.struct(*columns), "version")
        return rows.groupBy(*keys).agg(newest.alias("_t")).select(*keys, "_t.*")

    def overview(self) -> dict[str, DataFrame]:
        """The tables of a status page."""
        return ops.overview(
            self.checkpoints(), self.full_sync_tasks(), self.tasks(), self.schema_states(), self.outcomes()
        )

    def outcomes(self) -> DataFrame:
        """All outcomes, numbered by version and place."""
        rows = self.read("outcomes")
        return rows.withColumn("seq", F.shiftleft(F.col("version"), 40) + F.col("seq")).drop("version")

