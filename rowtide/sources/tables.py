"""Table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.sources.catalog import TableSpec


def read_table(spark: SparkSession, spec: TableSpec, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """Exactly the catalogue columns of one table, in catalogue order.

    ``source`` is a path for file formats and a table name for ``fmt="table"``. Reading a live
    database takes the JDBC source with a driver jar on the classpath: pass ``fmt="jdbc"`` with the
    usual options (``url``, ``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``).
    """
    if fmt == "table":
        df = spark.table(source)
    elif fmt == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=source, **options).load()
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    return df.select(*spec.columns)
