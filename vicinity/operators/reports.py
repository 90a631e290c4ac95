"""Index status, error lists, token usage and cost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.globs import exclude_paths, is_excluded
from vicinity.functions.tokens import count_tokens
from vicinity.schema import PREVIEW_ROWS, RETENTION_DAYS


def note_status(notes: DataFrame, state: DataFrame, errored: DataFrame, patterns=()) -> DataFrame:
    """``path, status``: excluded, then errored, then indexed, then pending."""
    yes = F.lit(True)
    stacked = (
        notes.select("path", yes.alias("note"))
        .unionByName(errored.select("path", yes.alias("failed")), True)
        .unionByName(state.select("path", yes.alias("known")), True)
    )
    return (
        stacked.groupBy("path")
        .agg(*[F.bool_or(c).alias(c) for c in ("note", "failed", "known")])
        .filter("note")
        .select(
            "path",
            F.when(is_excluded("path", patterns), "excluded")
            .when(F.col("failed"), "errored")
            .when(F.col("known"), "indexed")
            .otherwise("pending")
            .alias("status"),
        )
    )


def index_status(notes: DataFrame, state: DataFrame, errored: DataFrame, patterns=()) -> DataFrame:
    """One row ``total, excluded, errored, indexed, pending``."""
    status = note_status(notes, state, errored, patterns)
    return status.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == name).alias(name)
            for name in ("excluded", "errored", "indexed", "pending")
        ],
    )


def visible_errored(errored: DataFrame, notes: DataFrame, patterns=()) -> DataFrame:
    """Failures to show: the note exists and is not excluded."""
    return exclude_paths(errored, patterns).join(notes.select("path"), "path", "left_semi")


def index_counts(notes: DataFrame, state: DataFrame, index: DataFrame, errored: DataFrame) -> DataFrame:
    """One row ``indexed_notes, total_notes, chunks, errored``."""
    parts = [
        state.agg(F.count("*").alias("n")).withColumn("what", F.lit("indexed_notes")),
        notes.agg(F.count("*").alias("n")).withColumn("what", F.lit("total_notes")),
        index.agg(F.count("*").alias("n")).withColumn("what", F.lit("chunks")),
        errored.agg(F.count("*").alias("n")).withColumn("what", F.lit("errored")),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.agg(
        *[
            F.sum(F.when(F.col("what") == what, F.col("n"))).alias(what)
            for what in ("indexed_notes", "total_notes", "chunks", "errored")
        ]
    )


def preview_list(rows: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows by path, each with how many more there are."""
    total = rows.agg(F.count("*").alias("n"))
    more = F.greatest(total.scalar() - limit, F.lit(0))
    return rows.orderBy("path").limit(limit).withColumn("more", more)


def utc_day(ts: Column | str) -> Column:
    """Day of an instant in UTC, whatever the session's zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def usage_daily(usage: DataFrame) -> DataFrame:
    """Tokens and requests per UTC day."""
    return usage.groupBy(utc_day("ts").alias("day")).agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("request_count")
    )


def usage_total(usage: DataFrame) -> DataFrame:
    """One row ``tokens, request_count, first_use_date``; the date is empty without use."""
    return usage.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count("*").alias("request_count"),
        F.coalesce(F.min(utc_day("ts")).cast("string"), F.lit("")).alias("first_use_date"),
    )


def usage_retention(daily: DataFrame, asof, days: int = RETENTION_DAYS) -> DataFrame:
    """Days that are kept; the boundary day is one of them."""
    return daily.filter(F.col("day") >= F.date_sub(F.lit(asof).cast("date"), days))


def usage_today(daily: DataFrame, asof) -> DataFrame:
    """The row of one day, zeros when nothing was used."""
    day = F.lit(asof).cast("date")
    return daily.filter(F.col("day") == day).agg(
        day.alias("day"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("request_count"),
    )


def usage_cost(tokens: Column | str, price_per_million: Column | float | None) -> Column:
    """Estimated cost as text; null without a positive price."""
    count = F.col(tokens) if isinstance(tokens, str) else tokens
    price = (
        price_per_million if isinstance(price_per_million, Column)
        else F.lit(price_per_million).cast("double")
    )
    cost = count.cast("double") / 1_000_000 * price
    return F.when(price > 0, F.format_string("~$%.4f", cost))


def estimate_usage(texts: DataFrame, batch_cols, text_col: str = "text") -> DataFrame:
    """Usage of a provider that reports none: estimated tokens, one request per batch."""
    keys = [batch_cols] if isinstance(batch_cols, str) else list(batch_cols)
    return (
        texts.select(*keys, count_tokens(text_col, "ascii").alias("tokens"))
        .groupBy(*keys)
        .agg(F.sum("tokens").alias("tokens"), F.lit(1).alias("request_count"))
    )


def today() -> dt.date:
    """Current UTC day, for the ``asof`` parameters."""
    return dt.datetime.now(dt.timezone.utc).date()
