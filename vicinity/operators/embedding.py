"""Embedding jobs: batching, checks, failures as data.

The model is the user's. ``Embedder`` is the contract; it is pickled to the executors
and opened once per Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.schema import EMBED_BATCH, PAYLOAD_BUDGET_BYTES


#: Chunks whose texts and vectors a task holds as Python objects at once, in whole model batches.
CHUNKS_AT_ONCE = 512


class EmbeddingError(RuntimeError):
    """The embedder's answer does not fit the request."""


class Embedder(Protocol):
    """A model: ``dim`` values per text, at most ``max_tokens`` tokens of input."""

    dim: int
    max_tokens: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts."""


class HashEmbedder:
    """Offline embedder: hashed bag of words, scaled to unit length.

    The bucket of a word is the first 32 bits of its MD5 modulo ``dim``, so any engine
    can reproduce the vectors.
    """

    _cache_words = 1 << 18  # per Python worker

    def __init__(self, dim: int = 256, max_tokens: int = 512):
        self.dim, self.max_tokens = dim, max_tokens
        self._buckets: dict[bytes, int] = {}

    def __getstate__(self):
        return {"dim": self.dim, "max_tokens": self.max_tokens, "_buckets": {}}

    def _bucket(self, word: bytes) -> int:
        if len(self._buckets) >= self._cache_words:
            self._buckets.clear()
        digest = hashlib.md5(word, usedforsecurity=False).digest()
        found = self._buckets[word] = int.from_bytes(digest[:4], "big") % self.dim
        return found

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            # Bytes split at ASCII white space only.
            words = text.lower().encode("utf-8").split()
            known = self._buckets.get
            buckets = [known(w) for w in words]
            buckets = [self._bucket(w) if b is None else b for w, b in zip(words, buckets)]
            if buckets:
                out[row] = np.bincount(buckets, minlength=self.dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return list(np.divide(out, length, out=out, where=length > 0))


class RemoteEmbedder:
    """Embedder over an injected transport, packing requests by payload size.

    ``transport(list[str])`` returns vectors, either in order or as ``(index, vector)``
    pairs in any order. Texts beyond the limit are left to the server to cut.
    """

    def __init__(self, transport: Callable, dim: int, max_tokens: int,
                 budget: int | None = PAYLOAD_BUDGET_BYTES):
        self.transport, self.dim, self.max_tokens = transport, dim, max_tokens
        self.budget = budget

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        groups: dict[int, list[str]] = {}
        packer = PayloadPacker(self.budget) if self.budget else None
        for text in texts:
            number = packer.place(len(text.encode("utf-8"))) if packer else 0
            groups.setdefault(number, []).append(text)
        out: list = []
        for request in groups.values():
            out += ordered_vectors(self.transport(request), len(request))
        return out


class PayloadPacker:
    """Numbers consecutive texts so that each number's bytes stay within a budget."""

    def __init__(self, budget: int):
        self.budget, self.number, self.used = budget, 0, None

    def place(self, size: int) -> int:
        if self.used is not None and self.used + size > self.budget:
            self.number, self.used = self.number + 1, None
        self.used = (self.used or 0) + size
        return self.number


def ordered_vectors(answer, expected: int) -> list:
    """Check the number of vectors and their form; put indexed answers in order."""
    answer = list(answer)
    if len(answer) != expected:
        raise EmbeddingError(f"expected {expected} embeddings, got {len(answer)}")
    if answer and isinstance(answer[0], tuple):
        answer = [vector for _, vector in sorted(answer, key=lambda pair: pair[0])]
    for vector in answer:
        if not isinstance(vector, (list, tuple, np.ndarray)):
            raise EmbeddingError("embedding is not an array")
    return answer


def check_batch_size(n) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError(f"batch size must be a positive integer, got {n!r}")
    return n


def batches_of(items: list, n: int) -> list[list]:
    """Consecutive batches of at most ``n`` items, order kept."""
    check_batch_size(n)
    return [items[i : i + n] for i in range(0, len(items), n)]


def _embed_isolating(embedder, texts: list[str], batch_size: int):
    """Vectors and errors per text.

    A failing batch is halved until the bad texts fail alone and not their neighbours. A
    lost connection is no fault of a text: the batch fails as it is, after one call.
    """
    vectors: list = []
    errors: list = []
    todo = batches_of(texts, batch_size)[::-1]
    while todo:
        batch = todo.pop()
        try:
            vectors += ordered_vectors(embedder.embed_texts(batch), len(batch))
            errors += [None] * len(batch)
        except Exception as err:  # noqa: BLE001 - the failure becomes data
            if len(batch) == 1 or isinstance(err, (ConnectionError, TimeoutError)):
                vectors += [None] * len(batch)
                errors += [str(err)] * len(batch)
            else:
                half = len(batch) // 2
                todo += [batch[half:], batch[:half]]
    return vectors, errors


def sliced(batches, most: int):
    """Batches of at most so many rows, in order. Arrow batches come as large as a session sets them."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def embed_column(
    df: DataFrame,
    text_col: str,
    embedder: Embedder,
    batch_size: int = EMBED_BATCH,
    partitions: int | None = None,
    missing_only: bool = False,
) -> DataFrame:
    """Adds ``embedding`` and ``error``; exactly one of them is null per row.

    Narrow by default. ``partitions`` spreads a small or lopsided input over that many
    tasks first, which also sets how many calls to a remote model run at once. With
    ``missing_only``, rows that have an ``embedding`` keep it and do not go to the model.
    """
    check_batch_size(batch_size)
    if partitions:
        df = df.repartition(partitions)
    kept = [f for f in df.schema.fields if f.name not in ("embedding", "error")]
    schema = T.StructType(
        kept
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )
    names = [f.name for f in kept]
    vector = pa.list_(pa.float32())

    def run(batches):
        for batch in sliced(batches, batch_size * max(1, CHUNKS_AT_ONCE // batch_size)):
            asked = np.arange(batch.num_rows)
            if missing_only:
                asked = np.flatnonzero(batch.column("embedding").is_null().to_numpy(zero_copy_only=False))
            texts = batch.column(text_col).take(pa.array(asked)).to_pylist()
            texts = [t if t is not None else "" for t in texts]
            vectors, errors = _embed_isolating(embedder, texts, batch_size)
            made = pa.array([None if v is None else np.asarray(v, np.float32) for v in vectors], vector)
            failed = pa.array(errors, pa.string())
            if missing_only:
                place = np.arange(batch.num_rows)
                place[asked] = batch.num_rows + np.arange(len(asked))
                held = batch.column("embedding").cast(vector)
                made = pa.concat_arrays([held, made]).take(pa.array(place))
                failed = pa.concat_arrays([pa.nulls(batch.num_rows, pa.string()), failed]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [made, failed], names + ["embedding", "error"]
            )

    held = ["embedding"] if missing_only else []
    return df.select(*names, *held).mapInArrow(run, schema)


def split_into_batches(chunks: DataFrame, n: int = EMBED_BATCH) -> DataFrame:
    """Adds ``batch_no``: consecutive batches of at most ``n`` chunks of a note.

    Chunks of a note are numbered without gaps, so the number alone decides; no shuffle.
    """
    check_batch_size(n)
    return chunks.withColumn("batch_no", F.floor(F.col("chunk_index") / n).cast("int"))


def payload_batches(
    chunks: DataFrame, budget: int = PAYLOAD_BUDGET_BYTES, text_col: str = "content"
) -> DataFrame:
    """``path, chunk_index, bytes, batch_no``: greedy packing by UTF-8 size per note.

    A text larger than the budget is alone in its batch; a null one has no bytes. Where a batch
    starts depends on every text before it in the note, so the sizes of a note, and nothing
    else of it, are brought together and folded in order. The fold keeps where batches start, and
    the chunks follow from that. A note is one text value, which bounds its chunks.
    """
    check_batch_size(budget)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes")
    notes = chunks.select("path", F.struct("chunk_index", size).alias("item")).groupBy("path").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )

    def place(done, item):
        fits = (done.at > 0) & (done.used + item.bytes <= budget)
        return F.struct(
            F.when(fits, done.starts).otherwise(F.concat(done.starts, F.array(done.at))).alias("starts"),
            (F.when(fits, done.used).otherwise(0) + item.bytes).cast("bigint").alias("used"),
            (done.at + 1).alias("at"),
        )

    begin = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("at")
    )
    folded = notes.withColumn("starts", F.aggregate("items", begin, place, lambda done: done.starts))
    batches = folded.select("path", "items", "starts", F.posexplode("starts").alias("batch_no", "start"))
    end = F.coalesce(F.get("starts", F.col("batch_no") + 1), F.size("items"))
    held = F.slice("items", F.col("start") + 1, end - F.col("start"))
    return batches.select("path", "batch_no", F.explode(held).alias("item")).select(
        "path", "item.chunk_index", "item.bytes", "batch_no"
    )


def probe_dim(embedder: Embedder) -> int:
    """Width of the vectors: the declared one, else asked with one short text."""
    declared = getattr(embedder, "dim", None)
    if declared:
        return int(declared)
    return len(ordered_vectors(embedder.embed_texts(["test"]), 1)[0])
