"""A local Spark session for tests, checks and benchmarks."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str = "8", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # One machine, so a folder of its own is shared by all of the session's tasks.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rowtide-"))
        # Call sites for error messages cost a stack walk per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
