"""How filters overlap: duplicates by radix tries over ranges of texts, failures as bit masks."""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bucket_of, store, workspace

#: Filters by letter; a document's mask has the bit of each filter it fails.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")

#: Rows that the driver looks at to lay out the ranges, and the characters of each.
SAMPLE = 8192
HEAD_CHARS = 256
#: Weight of the texts in one trie: their bytes, and a node or two for each.
GROUP_WEIGHT = 16 << 20
ROW_WEIGHT = 256
#: Most prefixes the driver holds; a range beyond its weight is divided by a hash of the text.
MOST_RANGES = 2048
#: A text is looked up by broadcast if it is one of so many of the sampled rows, and of 8 at least.
#: The texts found so hold an eighth of the sample's bytes at most.
HEAVY_PARTS = 1024

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))


class RadixTrie:
    """Compressed trie over bytes; a terminal keeps the least number inserted with its text."""

    def __init__(self):
        self.labels, self.below, self.least = [b""], [{}], [None]

    def _node(self, label: bytes) -> int:
        self.labels.append(label)
        self.below.append({})
        self.least.append(None)
        return len(self.labels) - 1

    def insert(self, text: bytes, number: int) -> int:
        """Insert a text; returns its terminal, which stays the same whatever comes later."""
        node, at = 0, 0
        while at < len(text):
            below = self.below[node]
            child = below.get(text[at])
            if child is None:
                child = below[text[at]] = self._node(text[at:])
                node, at = child, len(text)
            else:
                label = self.labels[child]
                if not text.startswith(label, at):
                    shared = _shared(label, text, at)
                    upper = below[text[at]] = self._node(label[:shared])
                    self.labels[child] = label[shared:]
                    self.below[upper][label[shared]] = child
                    child, label = upper, label[:shared]
                node, at = child, at + len(label)
        if self.least[node] is None or number < self.least[node]:
            self.least[node] = number
        return node

    def terminals(self):
        """``(text, least number)`` of all terminals in the order of their texts."""
        stack = [(0, b"")]
        while stack:
            node, text = stack.pop()
            text += self.labels[node]
            if self.least[node] is not None:
                yield text, self.least[node]
            stack.extend((self.below[node][b], text) for b in sorted(self.below[node], reverse=True))


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest start of ``label`` that stands at ``at``, by halving."""
    low, high = 1, len(label)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def failed_filters(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails. Python splits bytes at the six
    ASCII white spaces, which are those of the filters."""
    words = text.split()
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * len(text.translate(None, INNER)),
        len(text) != len(text.translate(None, SIGNS)),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _flag_group(group: pa.Table) -> pa.Table:
    """One range: insert all its texts, judge each one once, set the bit of what is not the
    least of its text."""
    trie, judged = RadixTrie(), {}
    last = np.iinfo(np.int64).max
    ids = group["doc_id"].fill_null(last).to_numpy()
    ends = np.empty(len(ids), np.int64)
    texts = (text for chunk in group["text"].chunks for text in chunk.to_pylist())
    for row, (text, number) in enumerate(zip(texts, ids.tolist())):
        ends[row] = end = trie.insert(text, number)
        if end not in judged:
            judged[end] = failed_filters(text)
    least = np.array([last if n is None else n for n in trie.least], np.int64)
    mask = np.fromiter((judged[end] for end in ends.tolist()), np.int32, len(ends))
    mask |= np.where(ids > least[ends], DUPLICATE, 0).astype(np.int32)
    return pa.table({"doc_id": group["doc_id"], "part": group["part"], "mask": pa.array(mask)})


def _judge_batches(batches):
    for batch in batches:
        masks = [failed_filters(text.encode()) for text in batch["text"].to_pylist()]
        yield batch.append_column("mask", pa.array(masks, pa.int32()))


@dataclass(frozen=True)
class Ranges:
    """First texts of the ranges after the first, and by how many each is divided."""

    starts: list[str]
    parts: list[int]

    def number(self, text: Column) -> Column:
        """How many starts are at or below a text, by binary search."""
        steps, step = [], 1
        while step <= len(self.starts):
            steps.insert(0, step)
            step *= 2
        if not steps:
            return F.lit(0)
        # One literal that the optimiser unfolds, not one for each start.
        starts = F.from_json(F.lit(json.dumps(self.starts)), "array<string>")
        return F.aggregate(
            F.array(*(F.lit(s) for s in steps)),
            F.lit(0),
            lambda at, s: F.when(
                (at + s <= len(self.starts)) & (F.get(starts, at + s - 1) <= text), at + s
            ).otherwise(at),
        )

    def part(self, number: Column, text: Column) -> Column:
        parts = F.get(F.lit(np.array(self.parts, np.int64)), number)
        return F.pmod(F.xxhash64(text), parts)


def _shortest_after(before: str, text: str) -> str:
    """Shortest prefix of ``text`` that lies above ``before``, which is the smaller one."""
    same = next((i for i, (a, b) in enumerate(zip(before, text)) if a != b), len(before))
    return text[: same + 1]


def lay_out(rows: DataFrame, group_weight: int = GROUP_WEIGHT) -> tuple[Ranges, list[int]]:
    """Ranges of about equal weight from a sample, and hashes of texts that repeat in it.

    A range begins with the shortest prefix that tells its first sampled text from the one
    before, so prefixes are long only where many texts begin alike. Ranges that stay too
    heavy, as nothing in the sampled heads divides them, are dealt out by a hash of the
    whole text: equal texts always meet.
    """
    count = rows.count()
    if not count:
        return Ranges([], [1]), []
    drawn = rows.filter(bucket_of(F.monotonically_increasing_id()) < SAMPLE / count).select(
        F.substring("text", 1, HEAD_CHARS).alias("head"),
        (F.octet_length("text") + ROW_WEIGHT).cast("bigint").alias("weight"),
        F.xxhash64("text").alias("h"),
    )
    sample = sorted(drawn.collect(), key=lambda r: r.head.encode())
    if not sample:
        return Ranges([], [1]), []
    each = max(count / len(sample), 1.0)
    share = max(group_weight, each * sum(r.weight for r in sample) / MOST_RANGES)
    starts, weights, filled = [], [], 0.0
    for before, row in zip([None, *sample], sample):
        if filled >= share and before.head != row.head:
            starts.append(_shortest_after(before.head, row.head))
            weights.append(filled)
            filled = 0.0
        filled += row.weight * each
    parts = [max(math.ceil(w / (2 * group_weight)), 1) for w in [*weights, filled]]
    often = Counter(r.h for r in sample)
    least = max(len(sample) / HEAVY_PARTS, 8)
    return Ranges(starts, parts), [h for h, n in often.items() if n >= least]


def failures(docs: DataFrame, group_weight: int = GROUP_WEIGHT) -> DataFrame:
    """``doc_id``, ``part`` (the language) and ``mask`` of the failed filters of every row.

    Each text is moved once, to the trie of its range. Texts with a large share of all rows
    are not moved: their smallest identifiers are found by an aggregate and looked up where
    the rows lie. A null text counts as empty and a null language as the empty string. A null
    ``doc_id`` counts as larger than all others and as equal to another null; rows of one
    ``doc_id`` and text are no duplicates of one another.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ranges, often = lay_out(rows, group_weight)
    known = None
    if often:
        hot = rows.filter(F.xxhash64("text").isin(often))
        least = hot.groupBy("text").agg(F.min("doc_id").alias("least"))
        least = store(
            least.mapInArrow(_judge_batches, "text string, least bigint, mask int"),
            workspace(docs.sparkSession), "often",
        )
        later = (F.col("doc_id") > F.col("least")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
        mask = F.col("mask").bitwiseOR(F.when(later, DUPLICATE).otherwise(0))
        known = hot.join(F.broadcast(least), "text").select("doc_id", "part", mask.alias("mask"))
        rows = rows.filter(~F.xxhash64("text").isin(often))
    found = (
        rows.withColumn("range", ranges.number(F.col("text")))
        .select(
            "doc_id", "part", F.col("text").cast("binary").alias("text"), "range",
            ranges.part(F.col("range"), F.col("text")).alias("deal"),
        )
        # As many tasks as there are tries, whatever the number of shuffle partitions.
        .repartition(sum(ranges.parts), "range", "deal")
        .groupBy("range", "deal")
        .applyInArrow(_flag_group, "doc_id bigint, part string, mask int")
    )
    return found if known is None else found.unionByName(known)


def _bits(letters: Column) -> Column:
    """Mask of the filters whose letters a string holds."""
    held = (F.when(letters.contains(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS))
    return sum(held, F.lit(0))


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for each part, order of the filters and step, from the masks of all documents.

    Rows of one document count each. A document is good or toxic if any of its labels says
    so; labels without ``doc_id`` go nowhere. Masks are counted before anything is joined,
    so a ``doc_id`` with very many rows comes as few.
    """
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marked, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    own = _bits(F.substring("filter_order", F.col("step"), F.lit(1)))
    earlier = _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    fails, gone = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(earlier) != 0
    # Of all orders, each of the failed filters comes first in an equal part.
    share = F.when(fails, math.factorial(len(FILTERS)) / F.bit_count("mask"))

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0))

    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", ~gone & ~fails).alias("kept"),
        total("n", ~gone & fails).alias("removed"),
        total("n", gone & fails).alias("redundant"),
        total("n", F.col("mask") == own).alias("unique_fails"),
        total("good", ~gone & fails).alias("good_lost"),
        total("toxic", ~gone & fails).alias("toxic_lost"),
        F.coalesce(F.sum(F.col("n") * share.cast("bigint")), F.lit(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters overlap in every order they can be applied in, for each language.

    Needs ``doc_id``, ``lang`` and ``text``, and of the labels ``doc_id``, ``quality`` and
    ``toxic``; other columns are not looked at, whatever their names. Nulls are as in
    :func:`failures` and :func:`audit`. An empty table gives no rows. Lays out the ranges
    when called.
    """
    return audit(failures(docs), labels)
