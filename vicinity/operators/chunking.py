"""Split notes into overlapping chunks.

The split recurses over markdown separators and merges pieces greedily with an overlap
carried between neighbours, so each cut depends on the one before: not a relational
shape. It depends on one note only, though, so it runs as a narrow Arrow-batched step
with no shuffle and scales with the number of input partitions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.text import embed_text
from vicinity.functions.tokens import code_points, piece_counter
from vicinity.lineage import cut_lineage
from vicinity.operators.embedding import embed_column, sliced
from vicinity.operators.knn import best_by_block
from vicinity.schema import CHUNK_OVERLAP, SEMANTIC_CHUNK_TOKENS

# Markdown separators from coarse to fine, and the characters trimmed
# from the ends of a chunk.
SEPARATORS = (
    "\n## ",
    "\n### ",
    "\n#### ",
    "\n##### ",
    "\n###### ",
    "```\n\n",
    "\n\n***\n\n",
    "\n\n---\n\n",
    "\n\n___\n\n",
    "\n\n",
    "\n",
    " ",
    "",
)
TRIMMED = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

BLOCK_CHUNKS = 4096
#: Notes that are split, and whose chunks leave the task, together.
NOTES_AT_ONCE = 64
CHUNK_FIELDS = "path STRING, title STRING, content STRING, chunk_index INT, total_chunks INT"


@lru_cache(maxsize=None)
def _boundary(separator: str) -> re.Pattern:
    return re.compile(f"(?={re.escape(separator)})")


def _bounds(text: str, separator: str) -> np.ndarray:
    """Offsets of the pieces, each of which starts with the separator, and the end."""
    if not separator:
        return np.arange(len(text) + 1)
    if len(separator) == 1:
        inner = np.flatnonzero(code_points(text) == ord(separator))
    else:
        inner = np.array([m.start() for m in _boundary(separator).finditer(text)], int)
    return np.concatenate([[0], inner[inner > 0], [len(text)]])


class Splitter:
    """Splits one text into chunks of at most ``size`` tokens."""

    def __init__(self, size: int, overlap: int, counter="bytes"):
        self.size, self.overlap = size, overlap
        self.lengths = piece_counter(counter)

    def split(self, text: str) -> list[str]:
        return self._split(text, 0)

    def _split(self, text: str, level: int) -> list[str]:
        """Merge neighbouring pieces of the coarsest separator present; a piece that is
        a chunk by itself is split again at a finer one."""
        while SEPARATORS[level] not in text:
            level += 1
        bounds = _bounds(text, SEPARATORS[level])
        lengths = self.lengths(text, bounds)
        chunks: list[str] = []
        done = 0
        for large in np.flatnonzero(lengths >= self.size):
            chunks += self._merge(text, bounds[done : large + 1], lengths[done:large])
            piece = text[bounds[large] : bounds[large + 1]]
            if level + 1 < len(SEPARATORS):
                chunks += self._split(piece, level + 1)
            else:
                chunks.append(piece)
            done = large + 1
        return chunks + self._merge(text, bounds[done:], lengths[done:])

    def _merge(self, text: str, bounds: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Greedy windows over pieces; neighbours share pieces worth up to the overlap.

        Pieces are consecutive, so with running totals both the end of a window and the
        start of the next one are binary searches, and a chunk is a slice of the text.
        """
        chunks: list[str] = []
        upto = np.concatenate([[0], np.cumsum(lengths)])
        first, last = 0, len(lengths)
        while first < last:
            end = int(np.searchsorted(upto, upto[first] + self.size, "right")) - 1
            chunk = text[bounds[first] : bounds[end]].strip(TRIMMED)
            if chunk:
                chunks.append(chunk)
            if end >= last:
                break
            carried = max(upto[end] - self.overlap, upto[end + 1] - self.size)
            first = int(np.searchsorted(upto, carried, "left"))
        return chunks


def _check_sizes(chunk_size: int, overlap: int) -> None:
    if overlap >= chunk_size:
        raise ValueError(f"overlap {overlap} must be smaller than chunk size {chunk_size}")


def chunk_notes(
    notes: DataFrame,
    chunk_size: int = SEMANTIC_CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
    counter="bytes",
    partitions: int | None = None,
) -> DataFrame:
    """One row per chunk, numbered from 0, with the note's total.

    Further columns of ``notes`` are not read, so the scan stays at three columns.
    ``partitions`` spreads a lopsided input, such as one large row group, over that many
    tasks; inputs with many splits do without.
    """
    _check_sizes(chunk_size, overlap)
    notes = notes.select("path", "title", "content")
    if partitions:
        notes = notes.repartition(partitions)

    def run(batches):
        splitter = Splitter(chunk_size, overlap, counter)
        # A batch has thousands of notes, and their chunks are as large again.
        for batch in sliced(batches, NOTES_AT_ONCE):
            rows, contents, index, total = [], [], [], []
            for row, text in enumerate(batch.column("content").to_pylist()):
                if not text:
                    continue
                chunks = splitter.split(text)
                rows += [row] * len(chunks)
                contents += chunks
                index += range(len(chunks))
                total += [len(chunks)] * len(chunks)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path").take(take),
                    batch.column("title").take(take),
                    pa.array(contents, pa.string()),
                    pa.array(index, pa.int32()),
                    pa.array(total, pa.int32()),
                ],
                ["path", "title", "content", "chunk_index", "total_chunks"],
            )

    return notes.mapInArrow(run, CHUNK_FIELDS)


def chunk_size_sweep(
    notes: DataFrame,
    pairs: DataFrame,
    embedder,
    sizes=(2048, 1024, 512, 256),
    overlap: int = CHUNK_OVERLAP,
    counter="bytes",
) -> DataFrame:
    """Best chunk pair of each labelled note pair at several chunk sizes.

    ``pairs`` has ``src`` and ``dst``. One plan covers all sizes: chunks of every size
    are tagged and embedded together, then joined per pair and size.
    """
    pairs = pairs.select("src", "dst").distinct()
    wanted = pairs.select(F.col("src").alias("path")).union(pairs.select("dst")).distinct()
    notes = notes.join(wanted, "path", "left_semi")
    chunks = None
    for size in sizes:
        part = chunk_notes(notes, size, overlap, counter).withColumn("size", F.lit(size))
        chunks = part if chunks is None else chunks.unionByName(part)
    chunks = chunks.withColumn("text", embed_text("title", "content", "chunk_index"))
    # Both sides of the join read the vectors; the model must not run for each.
    vectors = cut_lineage(
        embed_column(chunks, "text", embedder).select("size", "path", "chunk_index", "embedding")
    )
    # Every source block meets every target block of its pair; a block is bounded, so
    # no task holds a whole note, and only the best hit per source chunk comes out.
    block = F.floor(F.col("chunk_index") / BLOCK_CHUNKS)
    last = vectors.groupBy("size", "path").agg(F.max(block).alias("last"))
    pairs = pairs.join(
        last.withColumnsRenamed({"path": "src", "last": "src_last"}), "src"
    ).join(last.withColumnsRenamed({"path": "dst", "last": "dst_last"}), ["size", "dst"])

    def side(own, other):
        mine = vectors.withColumn(f"{own}_block", block).withColumn(own, F.col("path"))
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_last")))
        return mine.join(pairs, ["size", own]).withColumn(f"{other}_block", every)

    hits = best_by_block(
        side("src", "dst").withColumnRenamed("chunk_index", "src_chunk"),
        side("dst", "src"),
        ["size", "src", "dst", "src_block", "dst_block"],
        ["size", "src", "dst", "src_chunk"],
        k=1,
        min_score=-1.0,
    )
    best = F.min(F.struct((-F.col("score")).alias("cost"), "src_chunk", "chunk_index"))
    return (
        hits.groupBy("size", "src", "dst")
        .agg(best.alias("best"))
        .select("size", "src", "dst", (-F.col("best.cost")).alias("score"),
                F.col("best.src_chunk").alias("src_chunk"),
                F.col("best.chunk_index").alias("dst_chunk"))
    )
