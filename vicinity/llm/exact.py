"""Exact deduplication as a stateful stream.

A feed of digests runs through a streaming aggregation whose keyed state lies on disk in
RocksDB and never expires. For each digest the state retains the largest stable
identifier, a content locator of the row that has it, and the number of rows. Later runs over a longer feed go
on from the same state. Where a digest was met again the full bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import PARTS, attach, fresh, store, workspace

#: Bytes of the feed in one micro-batch.
BATCH_BYTES = 16 << 30
#: Keyed state on disk, with changes uploaded instead of whole files. A partition's store
#: is closed when its task has committed, so executors hold those of running tasks only.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
FEED = "doc_id bigint, digest binary, row bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame, digest=sha256) -> DataFrame:
    """Identifier, digest and content locator of each row; a null text counts as empty.

    The locator numbers the rows by the partition that read them and their place in it.
    """
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(F.coalesce("text", F.lit(""))).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def update_state(spark: SparkSession, folder: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Run what is new in ``folder/feed`` through the stream, in micro-batches."""
    feed = (
        spark.readStream.schema(FEED)
        .option("maxBytesPerTrigger", batch_bytes)
        .parquet(f"{folder}/feed")
    )
    keyed = feed.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row", "doc_id").alias("keep_row"),
        F.min("row").alias("first_row"),
        F.count("*").alias("group_size"),
    )
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        (
            keyed.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """One row per digest out of the stream's state."""
    state = spark.read.format("statestore").load(f"{folder}/state")
    value = state.schema["value"].dataType.names
    # In the order of the aggregates: max; value and ordering of max_by; min; count.
    keep_id, keep_row, _, first_row, size = (F.col("value").getField(n) for n in value)
    return state.select(
        F.col("key.digest").alias("digest"),
        keep_id.alias("keep_id"),
        F.coalesce(keep_row, first_row).alias("keep_row"),
        size.alias("group_size"),
    )


def different_texts(docs: DataFrame, state: DataFrame, total: int, digest=sha256) -> DataFrame:
    """Digests met more than once under which not all texts have the same bytes.

    The smallest and the largest text under a digest are the same exactly if all are, so
    copies shrink before the shuffle and no group is gathered.
    """
    hits = state.filter("group_size > 1")
    texts = docs.select(
        F.coalesce("text", F.lit("")).alias("text"),
        digest(F.coalesce("text", F.lit(""))).alias("digest"),
    )
    met = attach(texts, hits.select("digest", "group_size"), "digest", "group_size", total)
    return (
        met.groupBy("digest")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .filter("low <> high")
        .select("digest")
    )


def deduplicate(
    docs: DataFrame, folder: str | None = None, batch_bytes: int = BATCH_BYTES, digest=sha256
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` of every row.

    Needs ``doc_id`` and ``text``; other columns are not looked at. Of rows with equal text
    the one with the largest ``doc_id`` is kept. A null or empty text is one text like any
    other; a null ``doc_id`` is smaller than all others, and a group without any keeps its
    first row. Of rows with the same ``doc_id`` and text one is kept. An empty table gives no
    rows. Runs the stream when called.
    """
    spark = docs.sparkSession
    folder = folder or workspace(spark)
    feed = store(digests(docs, digest), folder, "feed")
    update_state(spark, folder, batch_bytes)
    state = store(read_state(spark, folder), folder, "groups")
    total = feed.count()
    clash = store(different_texts(docs, state, total, digest), folder, "clash")
    keys = state
    if not clash.isEmpty():
        keys = state.join(clash, "digest", "left_anti")
    out = attach(feed, keys, "digest", "group_size", total, PARTS)
    out = out.withColumn("kept", F.col("row") == F.col("keep_row"))
    if not clash.isEmpty():
        out = out.unionByName(_by_text(docs, clash, folder, digest), True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "digest")


def _by_text(docs: DataFrame, clash: DataFrame, folder: str, digest) -> DataFrame:
    """The same decisions for digests with several texts, by the texts themselves."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text"))).join(clash, "digest", "left_semi")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), folder, "clashing")
    groups = rows.groupBy("digest", "text").agg(
        F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.count("*").alias("group_size"),
    )
    return rows.join(groups, ["digest", "text"]).withColumn(
        "kept", F.col("row") == F.col("keep_row")
    )


def keep_latest(docs: DataFrame) -> DataFrame:
    """The documents whose row is kept, with all their columns.

    A null text counts as empty. Of rows that repeat both ``doc_id`` and text one stays, a null
    ``doc_id`` being one like any other; columns may have any names.
    """
    own, name, mark = fresh(docs, "digest", "keep_id", "keep_digest")
    kept = (
        deduplicate(docs)
        .filter("kept")
        .select(F.col("doc_id").alias(name), F.col("digest").alias(mark))
    )
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own) == F.col(mark))
    return (
        docs.withColumn(own, sha256(F.coalesce("text", F.lit(""))))
        .join(kept, same)
        .dropDuplicates([own, "doc_id"])
        .drop(own, name, mark)
    )
