"""Language identification by a bidirectional recurrent network over bytes.

A text is read in windows of 64 bytes, each from a zero state as in training. The network
labels every position; a document's probabilities are the mean over all its positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import bucket_of, fresh
from vicinity.llm.recurrent import WINDOW, Weights, probabilities, states, train

#: Documents of each language to learn from, and bytes of each: the sample's bounds.
SAMPLE_DOCS = 256
SAMPLE_BYTES = 1024
FOLDS = 5
#: So many more rows than wanted are let through by their hash before the limit.
SPARE = 1.25
#: Windows that go through the network together.
BATCH = 768
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: Weights


def held_out(doc_id, folds: int = FOLDS, fold: int = 0):
    """Rows whose CRC-32 of the decimal identifier falls into the fold; a null does not."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, per_class: int, limit: int, column: str) -> DataFrame:
    """At most ``per_class`` rows or so of each class, chosen by a hash of the identifier.

    Counts the classes first, from the label column alone, then keeps the rows whose hash
    is below a threshold for their class. ``weight`` is how many rows of the class each
    stands for. Texts are cut to ``limit`` characters from a place the hash gives.
    """
    counts = {r[column]: r["count"] for r in docs.groupBy(column).count().collect()}
    place = bucket_of("doc_id", seed=1)
    keep = {c: min(1.0, per_class / n) for c, n in counts.items()}
    pairs = [F.lit(x) for c, k in keep.items() for x in (c, k)]
    if not pairs:
        return docs.limit(0).withColumn("weight", F.lit(1.0))
    chance = F.get(F.array(F.element_at(F.create_map(*pairs), F.col(column))), F.lit(0))
    start = (bucket_of("doc_id", seed=2) * F.greatest(F.length("text") - limit, F.lit(0))).cast("int")
    return (
        docs.filter(place < chance)
        .withColumn("weight", 1 / chance)
        .withColumn("text", F.col("text").substr(start + 1, F.lit(limit)))
    )


def language_sample(docs: DataFrame, per_class: int, limit: int) -> DataFrame:
    """At most ``per_class`` rows of each language, chosen by a hash of identifier and text.

    Identifiers may be null or repeat. The chance of a row goes by how many different rows its
    language has, so copies neither fill the sample nor leave it empty; a window with a partial
    limit makes ``per_class`` a bound whatever repeats. The number of languages is that of the
    column and has no bound of its own. Texts are cut to ``limit`` characters from a place the
    hash gives.
    """
    kinds = docs.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n"))
    counts = {r.lang: r.n for r in kinds.collect()}
    if not counts:
        return docs.limit(0)
    pairs = [F.lit(x) for c, n in counts.items() for x in (c, min(1.0, SPARE * per_class / max(n, 1)))]
    chance = F.element_at(F.create_map(*pairs), F.col("lang"))
    place = bucket_of("doc_id", "text", seed=1)
    room = F.greatest(F.length("text") - limit, F.lit(0))
    start = (bucket_of("doc_id", "text", seed=2) * room).cast("int")
    chosen = docs.filter(place < chance).select(
        "doc_id", F.col("text").substr(start + 1, F.lit(limit)).alias("text"), "lang", place.alias("place")
    )
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    ranked = chosen.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_class)
    return ranked.select("doc_id", "text", "lang")


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``size`` bytes, the text each is of, and how many of its bytes count."""
    parts = [-(-len(t) // size) for t in texts]
    flat = np.zeros(sum(parts) * size, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    used = np.full(len(owner), size, dtype=np.int64)
    at = 0
    for text, n in zip(texts, parts):
        flat[at * size : at * size + len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += n
        if n:
            used[at - 1] = len(text) - (n - 1) * size
    return flat.reshape(-1, size), owner, used


def fit(docs: DataFrame, folds: int = FOLDS, per_class: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from text and language of a bounded sample outside the held-out fold.

    Rows without a language or text do not count; a null ``doc_id`` is not held out, and rows
    may repeat. Runs two jobs and the training on the driver, whose cost does not depend on the
    table.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), folds))
    rows = language_sample(known, per_class, SAMPLE_BYTES)
    got = sorted((r.lang, r.doc_id or 0, r.text) for r in rows.collect() if r.text)
    languages = sorted({r[0] for r in got})
    if not languages:
        return LanguageModel([], {})
    windows, owner, used = windows_of([r[2].encode("utf-8", "replace") for r in got])
    labels = np.array([languages.index(r[0]) for r in got])[owner]
    mask = np.arange(WINDOW)[None, :] < used[:, None]
    return LanguageModel(languages, train(windows, labels, mask, len(languages)))


def document_probabilities(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; zeros for an empty one."""
    windows, owner, used = windows_of(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for at in range(0, len(windows), BATCH):
        part = slice(at, at + BATCH)
        probs = probabilities(model.weights, states(model.weights, windows[part]))
        live = np.arange(WINDOW)[:, None] < used[part][None, :]
        pooled = np.einsum("trc,tr->rc", probs, live.astype(np.float32))
        for c in range(total.shape[1]):
            total[:, c] += np.bincount(owner[part], pooled[:, c], minlength=len(texts))
    sizes = np.array([max(len(t), 1) for t in texts], dtype=float)
    return total / sizes[:, None]


def labels(model: LanguageModel, text: Column) -> Column:
    """``lang_pred`` and ``score`` of each text, as one struct."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        ask = np.flatnonzero(letters.to_numpy(dtype=bool))
        names = np.full(len(texts), UNKNOWN, dtype=object)
        score = np.zeros(len(texts))
        if len(ask) and model.languages:
            probs = document_probabilities(model, texts.iloc[ask].tolist())
            names[ask] = np.array(model.languages, dtype=object)[probs.argmax(axis=1)]
            score[ask] = probs.max(axis=1).clip(0, 1)
        return pd.DataFrame({"lang_pred": names, "score": score})

    whole = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    return of(whole, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: LanguageModel, folds: int = FOLDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    A null or empty text, one without a letter, and every text if the model knows no
    language, is ``und`` with score 0. A null ``doc_id`` is not held out; repeated rows
    get the same answer; an empty table gives no rows. Needs ``doc_id`` and ``text``; other
    columns are not looked at.
    """
    name = F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(
        name, held_out(name, folds).alias("held_out"), labels(model, F.col("text")).alias("of")
    )
    return rows.select("doc_id", "held_out", "of.lang_pred", "of.score")


def keep_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The documents of some language with a score of at least ``least``, with all columns.

    Null and empty texts and those without a letter go, as does every text if the model knows
    no language. Repeated rows stay or go together; columns may have any names.
    """
    (of,) = fresh(docs, "of")
    named = docs.withColumn(of, labels(model, F.col("text")))
    known = (F.col(of)["lang_pred"] != UNKNOWN) & (F.col(of)["score"] >= least)
    return named.filter(known).drop(of)
