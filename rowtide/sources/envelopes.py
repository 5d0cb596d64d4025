"""Keyed JSON messages: files, or a topic when the connector is on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.schemas import MESSAGES
from rowtide.session import ROW_GROUPS


def read_envelopes(
    spark: SparkSession, source: str, fmt: str = "parquet", stream: bool = False, max_files: int = 100, **options
) -> DataFrame:
    """Messages with their arrival order.

    Files hold the ``MESSAGES`` columns. With ``fmt="kafka"`` ``source`` is the topic, the arrival
    number is the offset, and the fragment number travels as a header.
    """
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        raw = (
            reader.format("kafka")
            .options(**{"startingOffsets": "earliest", "includeHeaders": "true", **options})
            .option("subscribe", source)
            .load()
        )
        header = F.try_element_at(F.filter("headers", lambda h: h["key"] == "fragment"), F.lit(1))
        return raw.select(
            "topic",
            "partition",
            F.col("offset").alias("arrival"),
            F.col("key").cast("string").alias("key"),
            F.coalesce(header["value"].cast("string").cast("int"), F.lit(0)).alias("fragment"),
            F.col("value").cast("string").alias("value"),
        )
    reader = reader.schema(MESSAGES).format(fmt).options(**options)
    if stream:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source)


def write_envelopes(messages: DataFrame, sink: str, fmt: str = "parquet", mode: str = "append", **options) -> None:
    """Write keyed messages (key, fragment, value) to a folder or a topic.

    A folder keeps whatever arrival columns the messages carry; a topic assigns its own offsets.
    """
    if fmt == "kafka":
        header = F.array(
            F.struct(F.lit("fragment").alias("key"), F.col("fragment").cast("string").cast("binary").alias("value"))
        )
        (
            messages.select("key", "value", header.alias("headers"))
            .write.format("kafka")
            .options(**{"kafka.acks": "all", "kafka.enable.idempotence": "true", **options})
            .option("topic", sink)
            .save()
        )
        return
    messages.write.mode(mode).format(fmt).options(**{**ROW_GROUPS, **options}).save(sink)
