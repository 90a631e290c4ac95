"""Read notes, links, change events and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.text import note_title
from vicinity.schema import USAGE


def read_notes(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Markdown files below a folder: ``path`` relative to it, title, content, mtime (ms)."""
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select("value", "_metadata.file_path", "_metadata.file_modification_time")
    )
    return _relative(raw, path).select(
        "path",
        note_title("path").alias("title"),
        F.col("value").alias("content"),
        F.unix_millis("file_modification_time").alias("mtime"),
    )


def read_snapshot(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``path, mtime`` of the files below a folder, without reading their content."""
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("_metadata.file_path", "_metadata.file_modification_time")
    )
    return _relative(raw, path).select(
        "path", F.unix_millis("file_modification_time").alias("mtime")
    )


def _relative(df: DataFrame, root: str) -> DataFrame:
    # Reported locations are URIs; only what follows the given folder is kept.
    folder = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    location = F.try_url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    start = F.locate(folder, location)
    return df.withColumn("path", F.substr(location, start + len(folder)))


def find_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested paths with their note, null fields where there is none."""
    return paths.select("path").distinct().join(notes, "path", "left")


def read_links(notes: DataFrame, style: str = "wiki", text_col: str = "content") -> DataFrame:
    """Distinct outgoing links ``src, dst`` found in the text.

    ``wiki`` finds ``[[target]]`` and resolves the target by path or file name;
    ``html`` takes the ``href`` values as they are.
    """
    if style == "html":
        targets = F.regexp_extract_all(F.col(text_col), F.lit('href="([^"]*)"'), F.lit(1))
        return notes.select(
            F.col("path").alias("src"), F.explode(targets).alias("dst")
        ).distinct()
    if style != "wiki":
        raise ValueError(f"unknown link style {style!r}")
    pattern = F.lit(r"\[\[([^\]\[|#]+)(?:#[^\]\[|]*)?(?:\|[^\]\[]*)?\]\]")
    raw = notes.select(
        F.col("path").alias("src"),
        F.explode(F.regexp_extract_all(F.col(text_col), pattern, F.lit(1))).alias("target"),
    ).select("src", F.trim("target").alias("target")).distinct()
    by_name = notes.select(
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.md\z", "").alias("target"),
        F.col("path").alias("dst"),
    )
    by_path = notes.select(
        F.regexp_replace("path", r"\.md\z", "").alias("target"), F.col("path").alias("dst")
    ).filter(F.col("target").contains("/"))
    by_file = notes.select(F.col("path").alias("target"), F.col("path").alias("dst"))
    # A file name shared by several notes goes to the first path.
    targets = (
        by_name.unionByName(by_path).unionByName(by_file)
        .groupBy("target").agg(F.min("dst").alias("dst"))
    )
    return raw.join(targets, "target").select("src", "dst").distinct()


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Request-level token ledger."""
    return spark.read.schema(USAGE).parquet(path)


def append_usage(usage: DataFrame, path: str) -> None:
    """Add requests to the ledger."""
    usage.select("ts", "tokens").write.mode("append").parquet(path)
