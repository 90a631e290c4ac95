"""Token counts and limits.

``bytes`` and ``ascii`` are estimates made of column expressions. A model's own
tokenizer is plugged in as a Python callable ``list[str] -> list[int]``, run by Arrow
batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.schema import (
    ASCII_CHARS_PER_TOKEN,
    ASCII_RATIO,
    BYTES_PER_TOKEN,
    CONTEXT_SAFETY_FACTOR,
    SEMANTIC_CHUNK_TOKENS,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units, which is how the estimates count characters."""
    wide = F.length(F.regexp_replace(_col(text), r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(_col(text)) + wide


def count_tokens(text: Column | str, counter="bytes") -> Column:
    """Tokens of a text by an estimate name or a batch callable."""
    column = _col(text)
    if counter == "bytes":
        return F.ceil(F.octet_length(column) / BYTES_PER_TOKEN).cast("int")
    if counter == "ascii":
        units = utf16_length(column)
        ascii_units = F.length(F.regexp_replace(column, r"[^\x00-\x7F]", ""))
        mostly_ascii = (units == 0) | (ascii_units / units > ASCII_RATIO)
        per_token = F.when(mostly_ascii, ASCII_CHARS_PER_TOKEN).otherwise(1)
        return F.ceil(units / per_token).cast("int")
    if not callable(counter):
        raise ValueError(f"unknown token counter {counter!r}")

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        counts = pd.Series(list(counter(known.tolist())), index=known.index, dtype="Int32")
        return counts.reindex(texts.index)

    return counted(column)


def python_counter(counter="bytes"):
    """The same count as a ``str -> int`` function, for use inside a task."""
    if counter == "bytes":
        return lambda s: -(-len(s.encode("utf-8", "surrogatepass")) // BYTES_PER_TOKEN)
    if counter == "ascii":
        return _ascii_estimate
    if not callable(counter):
        raise ValueError(f"unknown token counter {counter!r}")
    return lambda s: int(counter([s])[0])


def _ascii_estimate(text: str) -> int:
    if text.isascii():
        return math.ceil(len(text) / ASCII_CHARS_PER_TOKEN)
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2
    ascii_units = len(text.encode("ascii", "ignore"))
    per_token = ASCII_CHARS_PER_TOKEN if ascii_units / units > ASCII_RATIO else 1
    return math.ceil(units / per_token)


def piece_counter(counter="bytes"):
    """Counts of all pieces of a text, given their offsets: ``(text, bounds) -> array``."""
    if counter == "bytes":
        return lambda text, bounds: -(-np.diff(_byte_offsets(text)[bounds]) // BYTES_PER_TOKEN)
    if counter == "ascii":
        return _ascii_pieces
    if not callable(counter):
        raise ValueError(f"unknown token counter {counter!r}")
    return lambda text, bounds: np.array(
        counter([text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]), dtype=np.int64
    )


def code_points(text: str) -> np.ndarray:
    """The characters of a text as numbers."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _byte_offsets(text: str) -> np.ndarray:
    """UTF-8 offset of every character and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = code_points(text)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def _ascii_pieces(text: str, bounds: np.ndarray) -> np.ndarray:
    points = code_points(text)
    units = np.concatenate([[0], np.cumsum(1 + (points > 0xFFFF))])
    plain = np.concatenate([[0], np.cumsum(points < 0x80)])
    n, ascii_n = np.diff(units[bounds]), np.diff(plain[bounds])
    mostly_ascii = ascii_n / np.maximum(n, 1) > ASCII_RATIO
    return -(-n // np.where(mostly_ascii | (n == 0), ASCII_CHARS_PER_TOKEN, 1))


def cap_to_context(detected: Column | str, context: Column | str,
                   safety: float = CONTEXT_SAFETY_FACTOR) -> Column:
    """Detected token limit, held to a share of the model's context when known."""
    found, ctx = _col(detected), _col(context)
    return F.when(ctx > 0, F.least(found, F.floor(ctx * safety).cast("int"))).otherwise(found)


def chunk_size(models: DataFrame) -> DataFrame:
    """Chunk size per model: the semantic target, or the model's limit if smaller."""
    capped = cap_to_context("detected", "context")
    return models.withColumn("max_tokens", capped).withColumn(
        "chunk_size", F.least(F.lit(SEMANTIC_CHUNK_TOKENS), F.col("max_tokens"))
    )


def check_token_limit(df: DataFrame, max_tokens: int, counter="bytes",
                      col: str = "text") -> DataFrame:
    """Adds ``token_count``, ``max_tokens`` and ``is_over_limit``."""
    return (
        df.withColumn("token_count", count_tokens(col, counter))
        .withColumn("max_tokens", F.lit(max_tokens))
        .withColumn("is_over_limit", F.col("token_count") > max_tokens)
    )


def truncate_to_tokens(text: Column | str, max_tokens: int, counter="bytes") -> Column:
    """The text if it is within the limit, else a prefix found by bisection.

    For the byte estimate the bisection has a closed form: the longest prefix of whole
    characters within the byte budget, which needs no Python. The other counters are
    not monotone, so the search itself decides the result and is run as such.
    """
    column = _col(text)
    if counter == "bytes":
        return _byte_prefix(column, max_tokens * BYTES_PER_TOKEN)
    count = python_counter(counter)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else bisect_prefix(s, max_tokens, count))

    return cut(column)


def _byte_prefix(text: Column, budget: int) -> Column:
    raw = text.cast("binary")

    def continues(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    # A character has at most four bytes: step back over its continuation bytes.
    keep = (
        F.when(~continues(budget + 1), budget)
        .when(~continues(budget), budget - 1)
        .when(~continues(budget - 1), budget - 2)
        .otherwise(budget - 3)
    )
    prefix = F.substring(raw, F.lit(1), keep).cast("string")
    return F.when(F.length(raw) <= budget, text).otherwise(prefix)


def bisect_prefix(text: str, max_tokens: int, count) -> str:
    """Prefix on which a bisection over the UTF-16 length settles."""
    if count(text) <= max_tokens:
        return text
    units = text.encode("utf-16-le", "surrogatepass")

    def prefix(n: int) -> str:
        return units[: 2 * n].decode("utf-16-le", "surrogatepass")

    low, high, best = 0, len(units) // 2, ""
    while low < high:
        middle = (low + high + 1) // 2
        candidate = prefix(middle)
        if count(candidate) <= max_tokens:
            low, best = middle, candidate
        else:
            high = middle - 1
    # Half of a surrogate pair is no text in Spark.
    return best[:-1] if best and "\ud800" <= best[-1] <= "\udbff" else best


def chunk_token_profile(chunks: DataFrame, counter="bytes") -> DataFrame:
    """Per note: number of chunks and the spread of their token counts."""
    tokens = count_tokens("content", counter)
    return (
        chunks.select("path", tokens.alias("tokens"))
        .groupBy("path")
        .agg(
            F.count("*").alias("chunks"),
            F.min("tokens").alias("min_tokens"),
            F.max("tokens").alias("max_tokens"),
            F.sum("tokens").alias("sum_tokens"),
            F.percentile_approx("tokens", 0.5, 10000).alias("median_tokens"),
        )
    )
