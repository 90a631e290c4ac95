"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

WIDTH = 4
SEED = 42
BITS = 64
#: Shingles whose bits are counted at a time.
STRIDE = 1 << 15


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """XXH64 of every run of ``width`` words, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < width:
        return [xxh64_intdigest(line, SEED)]
    ends = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(at + 1 for at in ends)]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes set, as a signed 64-bit integer."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), STRIDE):
        part = np.array(hashes[at : at + STRIDE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def simhash(text: Column, width: int = WIDTH) -> Column:
    """Fingerprint of a text as a ``bigint``; texts without words have 0."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return of(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
