"""SparkSession factory with the settings that the library is tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "memlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with AQE, Arrow and ANSI mode on. Without ``master`` the cluster's own settings hold."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MEMLAKE_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
