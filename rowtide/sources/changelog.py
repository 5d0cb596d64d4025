"""Raw change logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.schemas import RAW


def read_change_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw log entries of a folder of JSON or Parquet files, types fixed, nothing inferred."""
    return spark.read.schema(RAW).format(fmt).load(path)


def stream_change_log(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    """The same folder as a stream, at most ``max_files`` new files per batch."""
    return spark.readStream.schema(RAW).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
