"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into three segments. Two fingerprints that differ in at most four
bits differ in at most one bit of some segment, so for each segment the Hamming ball of
radius one around its value is looked up among the values of all others, and what is found
is checked on the whole fingerprint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import attach, components, store, workspace
from vicinity.llm.fingerprints import BITS, as_hex, simhash

MAX_BITS = 4
#: Radius of the ball in each segment; (radius + 1) * segments must exceed ``MAX_BITS``.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more fingerprints than this is compared in blocks of this size.
BLOCK = 2048


def _segment(at: int, width: int):
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def _key(number: int, value):
    """Segment number and value in one number."""
    return F.shiftleft(F.lit(number).cast("bigint"), 32).bitwiseOR(value)


def table_entries(prints: DataFrame) -> DataFrame:
    """The bucket of each segment of each fingerprint."""
    keys = [_key(k, _segment(*s)) for k, s in enumerate(SEGMENTS)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def ball_entries(prints: DataFrame) -> DataFrame:
    """The buckets that each fingerprint asks.

    Of two values one bit apart exactly one has an odd number of set bits, and only that
    one asks for its neighbours; every value asks for itself.
    """
    keys = []
    for k, (at, width) in enumerate(SEGMENTS):
        value = _segment(at, width)
        near = [_key(k, value.bitwiseXOR(F.lit(1 << b))) for b in range(width)]
        odd = F.bit_count(value) % 2 == 1
        keys.append(F.when(odd, F.array(*near)).otherwise(F.array().cast("array<bigint>")))
        keys.append(F.array(_key(k, value)))
    return prints.select("fp", F.explode(F.flatten(F.array(*keys))).alias("key"))


def links(prints: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that differ in 4 bits or fewer.

    Not every link is there: within a bucket of more than ``block`` fingerprints only
    as many as keep the same components. A link may come more than once.
    """
    entries = store(table_entries(prints), folder, "entries")
    crowded = entries.groupBy("key").count().filter(F.col("count") > block)
    crowded = store(crowded.select("key"), folder, "crowded")
    asked = ball_entries(prints)
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    # A value that asks for itself meets a pair from both sides.
    own = F.col("value").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("part")
    parts = [F.when(F.shiftright("key", 32) == k, _segment(*s)) for k, s in enumerate(SEGMENTS)]
    asked = asked.withColumn("part", F.coalesce(*parts)).withColumnRenamed("key", "value")
    table = entries.withColumnRenamed("fp", "other").withColumnRenamed("key", "value")
    hot = crowded.withColumnRenamed("key", "value")
    # Spark takes the balls for no larger than the fingerprints they are made from, some 35 times
    # too low, and would broadcast them.
    found = (
        asked.join(hot, "value", "left_anti")
        .join(table.join(hot, "value", "left_anti").hint("merge"), "value")
        .filter((distance <= MAX_BITS) & (~own | (F.col("fp") < F.col("other"))))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    if crowded.isEmpty():
        return found
    return found.unionByName(_crowded_links(ball_entries(prints), crowded, folder, block))


def _crowded_links(asked: DataFrame, crowded: DataFrame, folder: str, block: int) -> DataFrame:
    """Spanning links of crowded buckets, from pairs of blocks of bounded size."""
    # Each crowded bucket holds over ``block`` entries, so there are few of them.
    rows = store(asked.join(F.broadcast(crowded), "key"), folder, "crowd")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    total = rows.count()
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = (
        attach(rows, sizes, "key", "n", total)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "fp", F.least("own", "mate").alias("left"), F.greatest("own", "mate").alias("right")
        )
    )
    return pairs.groupBy("key", "left", "right").applyInPandas(_forest, "a bigint, b bigint")


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the fingerprints within reach of each other."""
    fps = np.unique(rows["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
    a, b = [], []
    open_ = np.ones(len(fps), dtype=bool)
    for start in range(len(fps)):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue:
            at = queue.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(fps ^ fps[at]) <= MAX_BITS))
            open_[near] = False
            queue.extend(near.tolist())
            a.append(np.full(len(near), fps[at]))
            b.append(fps[near])
    empty = [np.zeros(0, dtype=np.uint64)]
    ends = [np.concatenate(x or empty).view(np.int64) for x in (a, b)]
    return pd.DataFrame({"a": ends[0], "b": ends[1]})


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row, and ``fingerprint`` in hex.

    ``component_id`` is the smallest ``doc_id`` that links reach. Texts without words have
    the fingerprint 0 and link like any other. A null ``doc_id`` is never the smallest; a
    component without any has a null id. Repeated rows fall together; an empty table gives
    no rows. Needs ``doc_id`` and ``text``; other columns are not looked at. Computes the
    links when called.
    """
    folder = workspace(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), simhash(F.col("text")).alias("fp")
    )
    rows = store(rows, folder, "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    prints = store(prints, folder, "distinct")
    edges = links(prints.select("fp"), folder, block)
    roots = components(edges, folder).withColumnRenamed("node", "fp")
    named = prints.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count("*").alias("members")
    )
    named = store(named, folder, "named")
    least = store(least, folder, "least")
    classes = attach(named, least, "root", "members", named.count())
    total = rows.count()
    return attach(rows, classes.select("fp", "n", "component_id"), "fp", "n", total).select(
        "doc_id", "fp", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest ``doc_id``.

    Rows without a ``doc_id`` stay. Of rows that repeat the kept ``doc_id`` all stay.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)


assert sum(w for _, w in SEGMENTS) == BITS and len(SEGMENTS) * 2 > MAX_BITS
