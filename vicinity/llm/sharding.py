"""Shards of near equal bytes from sampled splitters."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bucket_of, store, workspace

SHARDS = 8
#: Key ranges for each shard, and sampled keys for each range; both bound what the driver holds.
RANGES_PER_SHARD = 256
SAMPLES_PER_RANGE = 12
#: Times that ranges over twice their share are sampled and divided again.
ROUNDS = 3

LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Splitters:
    """Boundaries of the ranges in order of the key, and the shard and first slot of each range."""

    bounds: list[tuple[int, int, int]]
    shard: list[int]
    first_slot: list[int]

    def shard_of(self, number: Column) -> Column:
        return F.get(_array(self.shard), number).cast("int")

    def slot_of(self, number: Column, place: Column) -> Column:
        return F.get(_array(self.first_slot), number) + place


def _array(values) -> Column:
    """One literal, not one for each value, which would slow the planning down."""
    return F.lit(np.array(list(values), dtype=np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its size and its key: a hash of the text, the identifier, the row.

    Rows of equal text are neighbours in the order of the key; identifier and row only
    divide groups of equal text that are too large for a range.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "_size": (F.octet_length(text) + 1).cast("bigint"),
            "_h": F.xxhash64(text),
            "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)),
            "_row": F.monotonically_increasing_id(),
        }
    )


def range_number(bounds: list[tuple[int, int, int]]) -> Column:
    """How many boundaries are at or below the key of a row, by binary search."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    h, ident, row = (_array(column) for column in zip(*bounds))

    def reached(at: Column) -> Column:
        id_row = (F.get(ident, at) < F.col("_id")) | (
            (F.get(ident, at) == F.col("_id")) & (F.get(row, at) <= F.col("_row"))
        )
        return (F.get(h, at) < F.col("_h")) | ((F.get(h, at) == F.col("_h")) & id_row)

    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(bounds)) & reached(at + s - 1), at + s
        ).otherwise(at),
    )


def sample_keys(rows: DataFrame, share: float) -> list[tuple]:
    """Keys drawn with a chance in proportion to size, one for ``share`` bytes on average.

    Returned as (key, bytes it stands for) in order of the key.
    """
    drawn = rows.filter(bucket_of("_h", "_id", "_row") * share < F.col("_size"))
    got = drawn.select("_h", "_id", "_row", "_size").collect()
    return sorted(((r._h, r._id, r._row), max(share, r._size)) for r in got)


def quantiles(sample: list[tuple], share: float) -> list[tuple[int, int, int]]:
    """Boundaries after every ``share`` bytes of the sampled keys.

    A boundary lies before a whole group of equal text, unless the group spans several
    boundaries; then the further ones divide it.
    """
    out, filled = [], 0.0
    for key, size in sample:
        if filled >= share:
            start = (key[0], LOWEST, -1)
            fresh = not out or out[-1] < start
            out.append(start if fresh else key)
            filled = 0.0
        filled += size
    return sorted(set(out))


def _measure(rows: DataFrame, bounds) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range; there are no more than boundaries plus one."""
    found = (
        rows.groupBy(range_number(bounds).alias("n"))
        .agg(F.sum("_size").alias("size"), F.count("*").alias("rows"))
        .collect()
    )
    return {r["n"]: (r["size"], r["rows"]) for r in found}


def sampled_splitters(
    rows: DataFrame,
    shards: int = SHARDS,
    ranges_per_shard: int = RANGES_PER_SHARD,
    samples_per_range: int = SAMPLES_PER_RANGE,
) -> Splitters:
    """Splitters for the rows of :func:`keyed`, which should be stored.

    Reads the rows for their total, a sample, and the bytes of each range. Ranges that hold
    more than twice their share are sampled more densely and divided. The ranges then go to
    the least filled shard, the largest first; ranges of one group of equal text go
    together unless the group is larger than a shard.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return Splitters([], [0], [0])
    share = total / (shards * ranges_per_shard)
    bounds = quantiles(sample_keys(rows, share / samples_per_range), share)
    sizes = _measure(rows, bounds)
    for _ in range(ROUNDS):
        over = [n for n, (size, count) in sizes.items() if size > 2 * share and count > 1]
        if not over:
            break
        inside = rows.withColumn("_n", range_number(bounds)).filter(F.col("_n").isin(over))
        # A range may have become too large by a few large rows only, so cut twice as fine.
        finer = quantiles(sample_keys(inside, share / samples_per_range / 4), share / 2)
        if set(finer) <= set(bounds):
            break
        bounds = sorted({*bounds, *finer})
        sizes = _measure(rows, bounds)
    units: list[list[int]] = []
    for n in range(len(bounds) + 1):
        inner = n > 0 and bounds[n - 1][1:] != (LOWEST, -1)
        if inner and sum(sizes.get(m, (0, 0))[0] for m in units[-1]) < total / shards:
            units[-1].append(n)
        else:
            units.append([n])
    weight = {u[0]: sum(sizes.get(n, (0, 0))[0] for n in u) for u in units}
    shard, first_slot = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    fill, slots = [(0, s) for s in range(shards)], [0] * shards
    for unit in sorted(units, key=lambda u: (-weight[u[0]], u[0])):
        filled, into = heapq.heappop(fill)
        heapq.heappush(fill, (filled + weight[unit[0]], into))
        for n in unit:
            shard[n], first_slot[n] = into, slots[into]
            slots[into] += sizes.get(n, (0, 0))[1]
    return Splitters(bounds, shard, first_slot)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row.

    Size is the bytes of the text plus one. Slots count from 0 without gaps in each shard,
    along the ranges. A null text counts as empty, a null ``doc_id`` comes first in its group.
    Rows that are the same in everything are told apart by their place and may be divided.
    An empty table gives no rows. Needs ``doc_id`` and ``text``; other columns are not
    looked at. Runs the sampling when called.
    """
    folder = workspace(docs.sparkSession)
    text = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    rows = keyed(docs.select("doc_id", "text")).withColumn("_crc", text).drop("text")
    rows = store(rows, folder, "keys")
    found = sampled_splitters(rows, shards)
    place = F.expr("row_number() OVER (PARTITION BY _n ORDER BY _h, _id, _row) - 1")
    placed = rows.withColumn("_n", range_number(found.bounds)).withColumn("_place", place)
    return placed.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        found.shard_of(F.col("_n")).alias("shard"),
        found.slot_of(F.col("_n"), F.col("_place")).alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write the documents with all their columns under ``folder/shard=N``.

    Each task writes a share of the ranges, in order of the key. Columns keep their values whatever
    their names, but for one named ``shard``, which is left out as the folder says it. A null
    text counts as empty, a null ``doc_id`` comes first in its group. An empty table writes no shard.
    """
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c.lower() != "shard"))
    rows = keyed(docs.select("doc_id", "text", whole.alias("_whole")))
    keys = store(rows.select("_size", "_h", "_id", "_row"), workspace(docs.sparkSession), "keys")
    found = sampled_splitters(keys, shards)
    (
        rows.withColumn("_n", range_number(found.bounds))
        .withColumn("_shard", found.shard_of(F.col("_n")))
        .repartition("_n")
        .sortWithinPartitions("_shard", "_h", "_id")
        .select("_whole.*", F.col("_shard").alias("shard"))
        .write.partitionBy("shard")
        .parquet(folder)
    )
