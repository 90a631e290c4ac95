"""Helpers shared by the operators: stored steps, skew-proof lookups, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.lineage import checkpoint_dir
from vicinity.session import ship_package

#: A key with over one of so many parts of all rows is looked up by broadcast. There are
#: fewer such keys than parts, so the broadcast side has a fixed bound.
PARTS = 4096


def workspace(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint location."""
    ship_package(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write rows to the shared folder and read them from there."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, each with underscores before it until no column of the table has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def attach(
    left: DataFrame, right: DataFrame, key: str, count: str, total: int, parts: int = PARTS
) -> DataFrame:
    """Inner join of many rows with the one row that ``right`` has for each of their keys.

    ``count`` holds how many rows of ``left`` have the key and ``total`` how many there are.
    Keys with more than ``total / parts`` rows are broadcast, so their rows stay where they
    are; all others are shuffled, at any size, and no task gets more than that of any one
    key. ``left`` is read twice and should be stored.
    """
    limit = max(total // parts, 1)
    heavy = F.broadcast(right.filter(F.col(count) > limit))
    hot = left.join(heavy, key)
    rest = left.join(heavy.select(key), key, "left_anti")
    return hot.unionByName(rest.join(right.filter(F.col(count) <= limit).hint("merge"), key))


def bucket_of(*columns: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the values only."""
    spread = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 48))
    return spread.cast("double") / float(1 << 48)


def _star(edges: DataFrame, folder: str, name: str, large: bool) -> DataFrame:
    """One step: every node's neighbours move to the smallest of them.

    ``large`` moves the larger neighbours of a node, otherwise its smaller ones and itself.
    """
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    if large:
        pairs = pairs.unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
    least = pairs.groupBy("node").agg(F.min("near").alias("least"), F.count("*").alias("n"))
    total = edges.count() * (2 if large else 1)
    if large:
        least = least.withColumn("least", F.least("node", "least"))
        moved = attach(pairs, least, "node", "n", total).filter("near > node")
    else:
        own = least.select("node", F.col("node").alias("near"), "least")
        moved = attach(pairs, least, "node", "n", total).select("node", "near", "least")
        moved = moved.unionByName(own)
    out = moved.filter("near <> least").select(
        F.col("near").alias("a"), F.col("least").alias("b")
    )
    return store(out.distinct(), folder, name)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Smallest node reachable from each node that has a link.

    ``edges`` holds ``a`` and ``b``, whole numbers; the result ``node`` and ``root``, also
    for roots. Alternates large and small stars, written at each step, until nothing moves;
    the steps grow with the logarithm of the largest component.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = store(edges.distinct(), folder, "links0")
    seen, step = None, 0
    while True:
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen, step = tuple(mark), step + 1
        edges = _star(edges, folder, f"large{step}", True)
        edges = _star(edges, folder, f"small{step}", False)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
