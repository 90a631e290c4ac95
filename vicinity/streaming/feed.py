"""The change feed: raw events to changes worth processing.

The time of an event is its own, not the moment it is read. A burst of edits is released
once the watermark has passed its end; an event older than the watermark is dropped here
and found again by the next snapshot diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.globs import is_excluded
from vicinity.schema import EVENTS


def change_stream(spark: SparkSession, src: str, fmt: str = "parquet", patterns=(),
                  max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Stream of file events below a folder, filtered as ``filter_events`` does.

    ``max_files_per_trigger`` bounds how much one micro-batch takes. Events that come as
    JSON messages from another source go through ``parse_events``.
    """
    reader = spark.readStream.format(fmt).schema(EVENTS).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return filter_events(reader.load(src), patterns)


def parse_events(messages: DataFrame, col: str = "value") -> DataFrame:
    """Events out of JSON messages, such as the values of a message queue. Messages that
    are no events are left out."""
    event = F.from_json(F.col(col).cast("string"), EVENTS)
    return messages.select(event.alias("e")).filter("e.path IS NOT NULL").select("e.*")


def filter_events(events: DataFrame, patterns=()) -> DataFrame:
    """Events of markdown notes. Exclusions apply to create and modify events only: a
    deletion always counts, and a rename is judged when it is resolved."""
    shown = F.col("kind").isin("delete", "rename") | ~is_excluded("path", patterns)
    return events.filter(F.col("path").endswith(".md") & shown)


def debounce(events: DataFrame, delay: str = "1 second", watermark: str | None = None) -> DataFrame:
    """One row per burst of edits of a path: its last event, and the burst's span.

    A burst ends when no further edit comes within ``delay``. With a zero delay every
    edit is released as it comes. ``watermark`` is needed on streams.
    """
    if delay.split()[0] == "0":
        return events.select(
            "path", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"),
            "seq", "mtime", F.lit(1).cast("bigint").alias("edits"),
        )
    if watermark is not None:
        events = events.withWatermark("ts", watermark)
    last = F.max(F.struct("ts", "seq", "mtime"))
    return (
        events.groupBy("path", F.session_window("ts", delay).alias("burst"))
        .agg(last.alias("last"), F.count("*").alias("edits"))
        .select(
            "path",
            F.col("burst.start").alias("first_ts"),
            F.col("last.ts").alias("last_ts"),
            F.col("last.seq").alias("seq"),
            F.col("last.mtime").alias("mtime"),
            "edits",
        )
    )


def last_touches(events: DataFrame) -> DataFrame:
    """Last event that touched each path; ``stays`` is false where a rename left it.

    An aggregate over a struct, so a path with very many events is combined before the
    shuffle.
    """
    leaves = F.when(
        F.col("kind") == "rename",
        F.array(
            F.struct(F.col("path").alias("key"), F.lit(True).alias("stays")),
            F.struct(F.col("old_path").alias("key"), F.lit(False).alias("stays")),
        ),
    ).otherwise(F.array(F.struct(F.col("path").alias("key"), F.lit(True).alias("stays"))))
    touched = events.withColumn("touch", F.explode(leaves))
    last = F.max(F.struct("ts", "seq", "touch.stays", "kind", "old_path", "mtime"))
    return (
        touched.groupBy(F.col("touch.key").alias("path"))
        .agg(last.alias("last"))
        .select("path", "last.ts", "last.seq", "last.stays", "last.kind", "last.old_path",
                "last.mtime")
    )


def coalesce_changes(events: DataFrame) -> DataFrame:
    """Last event per path; earlier ones are superseded.

    A rename also supersedes what was queued for the path it leaves, while a later event
    on that path stands.
    """
    return last_touches(events).filter("stays").drop("stays")


def settled_events(events: DataFrame, delay: str = "1 second",
                   watermark: str | None = None) -> DataFrame:
    """Events with every burst of edits replaced by its last one; others pass through."""
    names = [part.split()[0] for part in EVENTS.split(", ")]
    edits = debounce(events.filter(F.col("kind") == "modify"), delay, watermark).select(
        F.col("last_ts").alias("ts"), "seq", F.lit("modify").alias("kind"), "path",
        F.lit(None).cast("string").alias("old_path"), "mtime",
    )
    return events.filter(F.col("kind") != "modify").select(*names).unionByName(
        edits.select(*names)
    )
