"""Pack token sequences by minimum bin slack.

Each bin starts with the longest piece left. A subset-sum table over the lengths that are
left, kept as bit sets, gives the fullest combination that goes with it, which is taken
out as often as it is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import store, workspace
from vicinity.llm.words import encode_bytes

CAPACITY = 1024
END_ID = 2
#: Pieces that are packed together; bounds a task's memory, and wastes a bin or so each.
BLOCK = 1 << 15

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece: all are full but the first, which takes the rest."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how often each, of the largest sum up to ``room``.

    ``counts`` has how many pieces of each length there are, longest first. Bit ``n`` of
    the set tells whether a sum ``n`` can be made.
    """
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in counts.items():
        if length > room:
            continue
        count, times = min(count, room // length), 1
        while count and not reach >> room:
            take = min(times, count)
            grown = reach | (reach << (length * take)) & within
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            count, times = count - take, times * 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_slack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece; no piece may be longer than ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    values, firsts, sizes = np.unique(-lengths[order], return_index=True, return_counts=True)
    counts = {int(-v): int(n) for v, n in zip(values, sizes)}
    cursor = {int(-v): int(at) for v, at in zip(values, firsts)}
    bins = np.zeros(len(lengths), dtype=np.int64)
    places = np.zeros(len(lengths), dtype=np.int64)
    number = 0
    while counts:
        longest = next(iter(counts))
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in chosen.items())
        new, place = number + np.arange(times), 0
        for length, n in chosen.items():
            for _ in range(n):
                rows = order[cursor[length] : cursor[length] + times]
                bins[rows], places[rows] = new, place
                cursor[length] += times
                place += length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        number += times
    return bins, places


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids, the end id included, in the columns ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            end, out = END_ID.to_bytes(4, "little"), []
            for name, row, ids in zip(names, rows, encode_bytes(texts, tokenizer, False, special=True)):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((name, piece, start, length, crc, row))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    A null text counts as empty and is one end id; a null ``doc_id`` is carried along.
    Repeated rows are packed as often as they come. An empty table gives no rows. Needs
    ``doc_id`` and ``text``; other columns are not looked at. Full pieces are sequences of
    their own. The others are dealt at random into blocks of about ``block`` pieces, each
    packed by one task. Reads the texts once, when called.
    """
    pieces = store(token_pieces(docs, tokenizer, capacity), workspace(docs.sparkSession), "pieces")
    part = pieces.filter(F.col("length") < capacity)
    blocks = -(-part.count() // block) or 1
    part = part.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], ignore_index=True)
        bins, places = minimum_slack(rows["length"].to_numpy(dtype=np.int64), capacity)
        return rows.assign(sequence_id=rows["block"] * (1 << 32) + bins, offset=places)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = f"{PIECES}, block bigint, sequence_id bigint, offset bigint"
    packed = part.groupBy("block").applyInPandas(of_block, schema).select(*columns)
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(full)
