"""Session helpers: durable scratch space and size-checked joins."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A side is broadcast only when it has been counted and holds at most this many rows.
BROADCAST_ROWS = 50_000
# Rows of messages may be wide. Parquet is read in batches of thousands of rows that end with a row group, so small
# groups bound what a task holds, writing and reading alike; the size is checked every few rows, not every hundred.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "10"}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``; the session must set it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return configured.rstrip("/")


# Scratch paths taken inside each open ``scratch_scope`` of a thread, innermost last.
_open = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the session's own scratch folder."""
    path = f"{shared_dir(spark)}/rowtide/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, cutting its lineage.

    The rows survive the loss of any executor. They stay until the enclosing ``scratch_scope``
    ends or ``clear_scratch`` is called.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**ROW_GROUPS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch paths this thread took inside the block once it ends."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch of this session; results still depending on it must have been read."""
    delete_path(spark, f"{shared_dir(spark)}/rowtide/{spark.sparkContext.applicationId}")


def file_system(spark: SparkSession, path: str):
    """Hadoop path and file system, so that any storage Spark can reach works."""
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located, located.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    located, files = file_system(spark, path)
    files.delete(located, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    located, files = file_system(spark, path)
    return files.exists(located)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole text at once, False when it exists already; of two writers one succeeds.

    The text is written beside it and moved into place, which a file system with atomic renames does once.
    """
    located, files = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(located), options)
    except Py4JJavaError:
        files.delete(draft, False)
        if files.exists(located):
            return False
        raise
    return True


def move_path(spark: SparkSession, path: str, to: str) -> None:
    located, files = file_system(spark, path)
    files.rename(located, spark._jvm.org.apache.hadoop.fs.Path(to))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none when there is no folder; drafts and hidden files left out."""
    located, files = file_system(spark, path)
    if not files.exists(located):
        return []
    return [n for s in files.listStatus(located) if not (n := s.getPath().getName()).startswith(("_", "."))]


def read_file(spark: SparkSession, path: str) -> str:
    located, files = file_system(spark, path)
    stream = files.open(located)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """No rows. The optimizer sees it, so joins and unions with it cost nothing, and no job makes it."""
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
    return spark.range(1).select(*fields).filter("false")


def pin_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Turn a DataFrame of at most ``max_rows`` rows into local data.

    Returns the (possibly unchanged) DataFrame and whether it met the bound. The fetch is
    limited to ``max_rows + 1`` rows, so an unexpectedly large input costs no more than that.
    """
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(fetched, schema=df.schema), True


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str | Column] | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join a large, possibly skewed side with a normally tiny one.

    The small side is written first, since it may be costly and is not known to be small before. Within
    the row bound it is broadcast and the large side does not move. Beyond it
    Spark joins by shuffle; with ``spread`` columns, rows of the large side are then spread over
    ``salts`` sub-keys (a hash of those columns) and the small side is repeated once per sub-key,
    so one hot join key is served by ``salts`` tasks.
    """
    small = materialize(small, "lookup")
    pinned, fits = pin_small(small, max_rows)
    if fits:
        return big.join(F.broadcast(pinned), on, how)
    # A hint, as Spark judges a side by its compressed files, which says nothing of the copies made of their rows.
    if not spread:
        return big.join(small.hint("merge"), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
