"""Export results as versioned JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.schema import EXPORT_VERSION

# Codes, messages and the timestamp form of the export contract.
NO_ACTIVE_FILE = "NO_ACTIVE_FILE"
NO_ACTIVE_FILE_TEXT = "No active markdown file"
SEARCH_FAILED = "SEARCH_FAILED"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def export_related(results: DataFrame, sources: DataFrame, generated_at=None) -> DataFrame:
    """``source_path, payload``: one JSON document per requested source.

    ``sources`` has ``source_path``, ``known`` (the note exists) and optionally ``error``
    (its search failed). Results come best first; no threshold is applied. A source's
    results are at most its result limit, so each array is small.
    """
    when = F.current_timestamp() if generated_at is None else F.lit(generated_at).cast("timestamp")
    stamp = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), ISO_MILLIS)
    entry = F.struct(
        F.col("rank"),
        F.col("path"),
        F.col("title"),
        F.col("similarity").alias("score"),
        F.col("similar_chunk").alias("excerpt"),
        F.col("is_linked").alias("linked"),
    )
    lists = results.groupBy("source_path").agg(
        F.array_sort(F.collect_list(entry)).alias("ranked")
    )
    error = F.col("error") if "error" in sources.columns else F.lit(None).cast("string")
    asked = sources.select("source_path", "known", error.alias("error"))
    joined = asked.join(lists, "source_path", "left")
    entries = F.transform(
        F.coalesce("ranked", F.array().cast("array<struct<rank:int,path:string,title:string,"
                                            "score:double,excerpt:string,linked:boolean>>")),
        lambda e: F.struct(
            e["path"].alias("path"), e["title"].alias("title"), e["score"].alias("score"),
            e["excerpt"].alias("excerpt"), e["linked"].alias("linked"),
        ),
    )
    done = F.to_json(
        F.struct(
            F.lit(EXPORT_VERSION).alias("version"),
            F.lit(True).alias("ok"),
            F.col("source_path").alias("sourcePath"),
            stamp.alias("generatedAt"),
            entries.alias("results"),
        )
    )

    def failed(code, message):
        return F.to_json(
            F.struct(
                F.lit(EXPORT_VERSION).alias("version"),
                F.lit(False).alias("ok"),
                F.lit(code).alias("code"),
                message.alias("error"),
                stamp.alias("generatedAt"),
            )
        )

    is_note = F.col("known") & F.col("source_path").endswith(".md")
    return joined.select(
        "source_path",
        F.when(~F.coalesce(is_note, F.lit(False)),
               failed(NO_ACTIVE_FILE, F.lit(NO_ACTIVE_FILE_TEXT)))
        .when(F.col("error").isNotNull(), failed(SEARCH_FAILED, F.col("error")))
        .otherwise(done)
        .alias("payload"),
    )


def write_export(exported: DataFrame, path: str) -> None:
    """One JSON document per line; the commit makes all of them visible at once."""
    exported.select("payload").write.mode("overwrite").text(path)
