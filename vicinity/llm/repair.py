"""Token ids in files compressed by Re-Pair grammars.

Documents are written in order of ``doc_id``. Each shard of about a million ids has a
grammar of its own: rules replace frequent pairs of neighbouring symbols by a new symbol,
again and again, never across the end of a document. A shard stores its rules, how many
ids each symbol expands to, and the symbols of each document, so a document or a part of it is
read without the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.words import encode_bytes

END_ID = 2
#: Ids in a shard, about.
SHARD_IDS = 1 << 20
#: A symbol takes two bytes, so ids and rules share 65,536 numbers.
SYMBOLS = 1 << 16
#: A pair becomes a rule if it comes at least so often in its shard.
LEAST = 12
#: Pairs are counted in slots, by so many upper bits of a hash at most.
SLOT_BITS = 20

SHARD = (
    "part int, before bigint, first_doc bigint, last_doc bigint, vocabulary int, "
    "rules binary, lengths binary, symbols binary, doc_ids array<bigint>, "
    "doc_symbols array<bigint>, doc_tokens array<bigint>"
)


@dataclass
class Grammar:
    """``rules[i]`` is the pair that symbol ``vocabulary + i`` stands for."""

    vocabulary: int
    rules: np.ndarray
    lengths: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols one after the other, and where each begins."""
        size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths])
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(begin[-1], dtype=np.uint32)
        flat[: self.vocabulary] = np.arange(self.vocabulary)
        for i, (left, right) in enumerate(self.rules.tolist()):
            at, middle = begin[self.vocabulary + i], begin[self.vocabulary + i] + size[left]
            flat[at:middle] = flat[begin[left] : begin[left + 1]]
            flat[middle : begin[self.vocabulary + i + 1]] = flat[begin[right] : begin[right + 1]]
        return flat, begin

    def length_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.vocabulary
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.vocabulary]
        return out


def frequent_pairs(seq: np.ndarray, places: np.ndarray, least: int, most: int):
    """Pairs at the given places that come at least ``least`` times there, most frequent first.

    Returns the places of their pairs, the rank of each, the pairs, and the places of pairs that
    could not be told. Pairs are counted in slots by a hash; a slot counts for one of its pairs,
    and places of the others are those left. If slots show no frequent pair, all pairs in
    question are counted one by one.
    """
    key = (seq[places].astype(np.uint32) << np.uint32(16)) | seq[places + 1]
    bits = min(SLOT_BITS, len(places).bit_length() + 1)
    slot = (key * np.uint32(2654435761)) >> np.uint32(32 - bits)
    often = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
    at, key, slot = places[often], key[often], slot[often]
    holder = np.zeros(1 << bits, dtype=np.uint32)
    holder[slot] = key
    mine = holder[slot] == key
    count = np.bincount(slot[mine], minlength=1 << bits)
    chosen = np.flatnonzero(count >= least)
    if not len(chosen):
        holder, slot, count = np.unique(key, return_inverse=True, return_counts=True)
        mine = np.ones(len(at), dtype=bool)
        chosen = np.flatnonzero(count >= least)
    left, at, slot = at[~mine], at[mine], slot[mine]
    chosen = chosen[np.argsort(-count[chosen], kind="stable")][:most]
    rank = np.full(len(holder), -1, dtype=np.int32)
    rank[chosen] = np.arange(len(chosen))
    ranks = rank[slot]
    return at[ranks >= 0], ranks[ranks >= 0], holder[chosen].astype(np.int64), left


def apart(at: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which of the places to replace so that none overlap: the better ranked first.

    Among neighbours of one rank, as in a run of one id, every second is taken.
    """
    after = np.r_[False, at[1:] == at[:-1] + 1]
    worse = np.zeros(len(at), dtype=bool)
    worse[1:] |= after[1:] & (ranks[1:] > ranks[:-1])
    worse[:-1] |= after[1:] & (ranks[:-1] > ranks[1:])
    same = np.r_[False, after[1:] & (ranks[1:] == ranks[:-1])]
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(same, 0, place))
    return ~worse & ((place - start) % 2 == 0)


def re_pair(
    ids: np.ndarray, last: np.ndarray, vocabulary: int, least: int = LEAST
) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, symbols, and which of them are the last of their document.

    Each round replaces all pairs that are frequent at that time, the most frequent first,
    until no pair is frequent or the symbols are used up. A round looks at all places of the pairs
    that can be frequent: those with a symbol of the round before, as all others have become
    fewer, and of the others those that it could not tell or could not replace.
    """
    if vocabulary > SYMBOLS or (len(ids) and ids.max() >= vocabulary):
        raise ValueError(f"ids must be below the vocabulary, and that at most {SYMBOLS}")
    seq, rules = ids.astype(np.uint16), np.zeros((0, 2), dtype=np.int64)
    lengths = np.zeros(0, dtype=np.int64)
    places = np.flatnonzero(~last[:-1])
    while len(places):
        room = SYMBOLS - vocabulary - len(rules)
        if room <= 0:
            break
        found, ranks, pairs, left = frequent_pairs(seq, places, least, room)
        keep = apart(found, ranks)
        used = np.bincount(ranks[keep], minlength=len(pairs)) >= 2
        if not used.any():
            places = left
            continue
        keep &= used[ranks]
        at, ranks = found[keep], ranks[keep]
        number = np.cumsum(used) - 1 + vocabulary + len(rules)
        new = np.stack([pairs[used] // SYMBOLS, pairs[used] % SYMBOLS], axis=1)
        grammar = Grammar(vocabulary, rules, lengths)
        size = grammar.length_of(new[:, 0]) + grammar.length_of(new[:, 1])
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size])
        seq[at] = number[ranks]
        last[at] = last[at + 1]
        open_ = np.zeros(len(seq), dtype=bool)
        for again in (left, found[~keep], at, np.maximum(at, 1) - 1):
            open_[again] = True
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq, last, open_ = seq[stay], last[stay], open_[stay]
        places = np.flatnonzero(open_[:-1] & ~last[:-1])
    return Grammar(vocabulary, rules, lengths), seq, last


def to_shard(docs: list[tuple[int, bytes]], vocabulary: int) -> dict:
    """One row of the file: ``docs`` are identifiers and ids of consecutive documents."""
    sizes = np.array([len(ids) // 4 for _, ids in docs], dtype=np.int64)
    ids = np.frombuffer(b"".join(ids for _, ids in docs), dtype="<u4")
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    grammar, symbols, last = re_pair(ids, last, vocabulary)
    ends = np.flatnonzero(last) + 1
    names = [name for name, _ in docs]
    known = [n for n in names if n is not None]
    return {
        "first_doc": min(known, default=None),
        "last_doc": max(known, default=None),
        "vocabulary": vocabulary,
        "rules": grammar.rules.astype("<u2").tobytes(),
        "lengths": grammar.lengths.astype("<u4").tobytes(),
        "symbols": symbols.astype("<u2").tobytes(),
        "doc_ids": names,
        "doc_symbols": np.diff(ends, prepend=0).tolist(),
        "doc_tokens": sizes.tolist(),
    }


class Shard:
    """A row of the file, decoded on demand."""

    def __init__(self, row: dict):
        self.grammar = Grammar(
            row["vocabulary"],
            np.frombuffer(row["rules"], dtype="<u2").reshape(-1, 2),
            np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64),
        )
        self.symbols = np.frombuffer(row["symbols"], dtype="<u2")
        self.begin = np.concatenate([[0], np.cumsum(row["doc_symbols"], dtype=np.int64)])
        self.flat, self.at = self.grammar.expansions()

    def ids(self) -> np.ndarray:
        """Ids of all documents of the shard."""
        size, begin = self.grammar.length_of(self.symbols), self.at[self.symbols]
        offset = np.cumsum(size) - size
        return self.flat[np.repeat(begin - offset, size) + np.arange(size.sum())]

    def document(self, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard's document ``number``.

        Only the symbols that reach into the span are expanded.
        """
        symbols = self.symbols[self.begin[number] : self.begin[number + 1]]
        size = self.grammar.length_of(symbols)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        size, begin = size[a:b], self.at[symbols[a:b]]
        offset = np.cumsum(size) - size
        ids = self.flat[np.repeat(begin - offset, size) + np.arange(size.sum())]
        skip = start - (int(ends[a]) - int(size[0]))
        return ids[skip : skip + stop - start]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, shard_ids: int = SHARD_IDS
) -> None:
    """Encode and write all documents, in ascending order of ``doc_id``.

    ``tokenizer`` names a file of the kind with word ends, ``vocabulary`` how many ids it
    has, at most ``SYMBOLS``. A null text counts as empty and is one end id; a null ``doc_id`` comes first;
    repeated rows are written as often as they come; an empty table makes an empty file.
    Needs ``doc_id`` and ``text``; other columns are not looked at. Each task encodes and
    writes a range of documents and holds one shard at a time, or one document if larger.
    """
    if vocabulary > SYMBOLS:
        raise ValueError(f"a symbol takes two bytes, so a vocabulary has at most {SYMBOLS} ids")
    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
    names = [c.split()[0] for c in SHARD.split(", ")]
    schema = pa.schema(list(zip(names, [*kinds, longs, longs, longs])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        size, end = 0, END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids_of = encode_bytes(texts, tokenizer, True, special=True)
            for name, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                held.append((name, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    row = to_shard(held, vocabulary) | {"part": part, "before": before}
                    yield _batch([row], schema)
                    before, held, size = before + size, [], 0
        if held:
            row = to_shard(held, vocabulary) | {"part": part, "before": before}
            yield _batch([row], schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # The text's hash only divides rows that repeat one doc_id.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(run, SHARD).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of all documents.

    ``start`` counts the ids of all documents before.
    """
    schema = "doc_id bigint, part int, start bigint, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, out = Shard(row).ids().astype("<u4").tobytes(), 0, []
                for name, n in zip(row["doc_ids"], row["doc_tokens"]):
                    out.append((name, row["part"], row["before"] + at, n, ids[4 * at : 4 * (at + n)]))
                    at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )

    shards = spark.read.schema(SHARD).parquet(path)
    # One row of two numbers for each task that wrote, so small enough to broadcast.
    parts = shards.groupBy("part").agg(
        F.sum(F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("ids_in")
    )
    bases = parts.selectExpr(
        "part", "sum(ids_in) OVER (ORDER BY part) - ids_in AS base"
    )
    return (
        shards.mapInArrow(run, schema)
        .join(F.broadcast(bases), "part")
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
    )

