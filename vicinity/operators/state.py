"""Keyed state tables: indexed mtimes and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.schema import ERRORED, columns


def set_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State with the rows put in place of those with the same path."""
    return drop_state(state, rows).unionByName(rows)


def drop_state(state: DataFrame, paths: DataFrame) -> DataFrame:
    """State without the given paths."""
    return state.join(paths.select("path").distinct(), "path", "left_anti")


def get_state(state: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested paths with their stored row, null where there is none."""
    return paths.select("path").distinct().join(state, "path", "left")


def clear_state(state: DataFrame) -> DataFrame:
    """The same table without rows."""
    return state.limit(0)


def count_state(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("n"))


def set_errored(errored: DataFrame, rows: DataFrame, at=None) -> DataFrame:
    """Failures with new rows, stamped with the time of the attempt."""
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    stamped = rows.withColumn("last_tried_at", when).select(*columns(ERRORED))
    return set_state(errored.select(*columns(ERRORED)), stamped)
