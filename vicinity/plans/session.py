"""Local session for tests, checks and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vicinity")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Bursts of edits of one path are merged before the shuffle, not only after it.
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
