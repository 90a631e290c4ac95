"""Quality classification by compression.

Labelled good and bad text each fill a zstandard dictionary. A text is compressed with
both, segment by segment so that a long text does not become its own dictionary. The
difference of the sizes over the length is turned into a probability by a logistic
curve fitted to labelled texts that are in neither dictionary. Short texts say little, so
the shorter a text, the closer its score is to the share of good labels.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bucket_of, fresh
from vicinity.llm.language import held_out, labelled_sample

#: Bounds of the sample: documents of each label for the dictionaries and characters of
#: all of them together, and documents of each label for the curve with characters of each.
DICTIONARY_DOCS = 1000
DICTIONARY_CHARS = 800_000
CURVE_DOCS = 1500
CURVE_CHARS = 20_000
LEVEL = 6
SEGMENT = 1024
#: A text of so many bytes is judged half by the difference and half by the share of labels.
SLACK = 200
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7


@dataclass
class QualityModel:
    """``prior`` is the log odds of label 1."""

    good: bytes
    bad: bytes
    slope: float
    base: float
    prior: float

    @property
    def blank(self) -> bool:
        """It has learned neither texts nor a share of labels."""
        return not self.good and self.prior == 0

    def score(self, difference: np.ndarray, length: np.ndarray) -> np.ndarray:
        trust = length / (length + SLACK)
        odds = trust * (self.slope * difference + self.base) + (1 - trust) * self.prior
        return _share(odds)


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _compressor(text: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=words, write_content_size=False, write_dict_id=False
    )


def size_differences(texts: Iterator[bytes], good: bytes, bad: bytes) -> Iterator[float]:
    """How many bytes fewer the dictionary of good text takes, over the length."""
    pair = [_compressor(bad), _compressor(good)] if good and bad else []
    for text in texts:
        sizes = [0, 0]
        for at in range(0, len(text) if pair else 0, SEGMENT):
            part = text[at : at + SEGMENT]
            for k in (0, 1):
                sizes[k] += len(pair[k].compress(part))
        yield (sizes[0] - sizes[1]) / max(len(text), 1)


def logistic(
    difference: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> tuple[float, float, float]:
    """Slope, base and prior of the curve by Newton's method, slightly drawn to zero slope.

    The difference is scaled, so the draw does not depend on its units. Labels are smoothed
    by one document of each kind, which keeps separable samples finite.
    """
    prior = float(np.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1)))
    scale = float(np.sqrt((weight * difference**2).sum() / weight.sum())) or 1.0
    trust = length / (length + SLACK)
    z = np.stack([trust * difference / scale, trust], axis=1)
    soft = np.where(y == 1, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    beta, draw = np.array([0.0, prior]), np.array([1e-4 * weight.sum(), 0.0])
    for _ in range(60):
        p = _share(z @ beta + (1 - trust) * prior)
        slope = z.T @ (weight * (soft - p)) - draw * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(draw + 1e-9)
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1]), prior


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from a bounded sample of labelled documents outside the held-out fold.

    Samples identifiers by their hash, so the texts are read once and only the sample's
    are kept. Without labels of both kinds every score goes by their share alone. Of several
    labels of one ``doc_id`` the lowest counts; labels without one do not.
    """
    known = labels.filter("quality in (0, 1)").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    known = known.filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"), FOLDS, FOLD))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("text", F.lit(""))
    chosen = labelled_sample(known, DICTIONARY_DOCS + CURVE_DOCS, 0, "quality").drop("text")
    # A few thousand identifiers at most, whatever the size of the tables.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"
    )
    share = DICTIONARY_DOCS / (DICTIONARY_DOCS + CURVE_DOCS)
    found = {r.quality: r["count"] for r in chosen.groupBy("quality").count().collect()}
    chars = {q: int(DICTIONARY_CHARS / max(found.get(q, 0) * share, 1)) for q in (0, 1)}
    first = bucket_of("doc_id", seed=3) < share
    limit = F.when(~first, CURVE_CHARS).when(F.col("quality") == 1, chars[1]).otherwise(chars[0])
    room = F.greatest(F.length("text") - limit, F.lit(0))
    start = (bucket_of("doc_id", seed=4) * room).cast("int")
    rows = texts.select(
        "doc_id",
        "quality",
        "weight",
        first.alias("first"),
        F.encode(F.coalesce(F.col("text").substr(start + 1, limit), F.lit("")), "utf-8").alias("text"),
    )
    # One row of each identifier, so that repeated ones do not enlarge the sample.
    rows = rows.groupBy("doc_id", "quality", "weight", "first").agg(F.min("text").alias("text"))
    learned = rows.filter("first").orderBy("doc_id", "text").collect()
    bad, good = (b"\n".join(bytes(r.text) for r in learned if r.quality == q) for q in (0, 1))
    # Dictionaries of one size, so that neither kind knows more words.
    size = min(len(good), len(bad))
    good, bad = good[:size], bad[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = list(size_differences(texts, good, bad))
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, pa.float64()),
                    pa.array(sizes, pa.float64()),
                    batch.column("quality"),
                    batch.column("weight"),
                ],
                names=["x", "n", "quality", "weight"],
            )

    curve = (
        rows.filter("NOT first")
        .select("text", "quality", "weight")
        .mapInArrow(run, "x double, n double, quality int, weight double")
        .collect()
    )
    seen = np.array([tuple(r) for r in curve], dtype=float).reshape(-1, 4)
    y = seen[:, 2].astype(int)
    if not size or len(set(y.tolist())) < 2:
        kinds = [(r.quality, r.weight) for r in (*learned, *curve)]
        ones = sum(w for q, w in kinds if q == 1)
        rest = sum(w for q, w in kinds if q == 0)
        return QualityModel(b"", b"", 0.0, 0.0, float(np.log((ones + 1) / (rest + 1))))
    return QualityModel(good, bad, *logistic(seen[:, 0], seen[:, 1], y, seen[:, 3]))


def scores(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for each text; a null counts as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.fromiter(size_differences(texts, model.good, model.bad), float, len(texts))
        return pd.Series(model.score(x, texts.str.len().to_numpy(dtype=float)))

    return of(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    A null text counts as empty; an empty one has the share of label 1 as its score. A
    null ``doc_id`` is not held out; repeated rows get the same answer; an empty table
    gives no rows. Needs ``doc_id`` and ``text``; other columns are not looked at.
    """
    name = F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(
        name, held_out(name, FOLDS, FOLD).alias("held_out"), scores(model, F.col("text")).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns.

    A null text counts as empty and stays or goes by the share of label 1. Repeated rows stay
    or go together; columns may have any names. A model that has learned nothing, as without
    any label, rejects nothing, with a warning.
    """
    if model.blank:
        warnings.warn("no labels to learn quality from: all documents are kept", stacklevel=2)
        return docs
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, scores(model, F.col("text"))).filter(F.col(score) >= threshold).drop(score)
