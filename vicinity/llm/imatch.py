"""I-Match fingerprints: hashes of the sorted distinct terms of a frequency band, one for each of
several random subsets of the lexicon."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.sharding import quantiles, range_number, sample_keys

#: Document frequencies are counted for the terms of a slot together, in so many slots.
SLOTS = 1 << 20
#: A term is kept if its inverse document frequency, as a part of the largest possible one
#: (that of a term in one document), lies in this band.
BAND = (0.15, 0.6)
#: Documents with fewer terms in the band use all their terms.
LEAST_TERMS = 8
#: The lexicon is dealt out at random by splitting it in four so many times, and each part is
#: thinned to a quarter so many times less one; each step takes two further bits of the terms.
SPLITS = 3
LEVELS = 2
FIRST_BIT = 22

#: Bytes of the texts in one range of documents, ranges at most, and sampled keys for each range.
RANGE_BYTES = 8 << 20
MOST_RANGES = 16384
SAMPLES = 8
ROW_BYTES = 512
DIGITS = 4
EMPTY = "0" * DIGITS


def hashed_terms(text: Column) -> Column:
    """Hashes of the terms in their order: runs of letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def terms(text: Column) -> Column:
    """Sorted distinct hashes of the terms."""
    return F.sort_array(F.array_distinct(hashed_terms(text)))


def _slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS))


def band_words(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Slots whose terms lie in the band, as 64 bits a number.

    Document frequencies are counted over the whole texts of all documents. What comes back
    has a fixed size whatever the data. With ``n`` documents a frequency of ``n ** (1 - b)``
    has the inverse document frequency ``b``. Terms that share a slot are counted together,
    which makes them look more frequent and never less.
    """
    counts = (
        docs.select(F.explode(F.array_distinct(F.transform(hashed_terms(_text()), _slot))).alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("df"))
    )
    n = F.lit(max(docs.count(), 1)).cast("double")
    low, high = band
    kept = (F.col("df") >= F.pow(n, F.lit(1 - high))) & (F.col("df") <= F.pow(n, F.lit(1 - low)))
    # A shift looks at the lowest six bits of the number of places only.
    bits = counts.filter(kept).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").cast("int"))).alias("bits")
    )
    words = [0] * (SLOTS // 64)
    for row in bits.collect():
        words[row.word] = row.bits
    return words


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def in_band(found: Column, words: list[int]) -> Column:
    """Those of the sorted terms that lie in the band, or all if they are too few."""
    # One literal that the optimiser unfolds, not one for each number.
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def kept(term: Column) -> Column:
        slot = _slot(term)
        bits = F.get(table, F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftrightunsigned", bits, slot.cast("int")).bitwiseAND(1) == 1

    return F.filter(found, kept)


def _split(subsets: Column, shift: int) -> Column:
    """Each subset in four, by two bits of the terms."""
    values = F.array(*(F.lit(v << shift).cast("bigint") for v in range(4)))
    mask = F.lit(3 << shift).cast("bigint")
    return F.flatten(
        F.transform(
            subsets,
            lambda s: F.transform(values, lambda v: F.filter(s, lambda term: term.bitwiseAND(mask) == v)),
        )
    )


def _thinned(subsets: Column, shift: int) -> Column:
    """The first of the four that :func:`_split` gives for each subset."""
    mask = F.lit(3 << shift).cast("bigint")
    return F.transform(subsets, lambda s: F.filter(s, lambda term: term.bitwiseAND(mask) == 0))


def _hashed(subsets: Column) -> Column:
    """Hexadecimal digits for each subset, zeros where it has no term."""
    return F.transform(
        subsets,
        lambda s: F.when(F.size(s) == 0, EMPTY).otherwise(
            F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(s), F.lit((1 << 4 * DIGITS) - 1)) + 1)), DIGITS, "0")
        ),
    )


def with_hashes(rows: DataFrame, text: Column, words: list[int], name: str) -> DataFrame:
    """Adds the fingerprint of a text: its hashes for all subsets of the lexicon, one after the other.

    The first subsets deal the lexicon out into parts at random; from each of these, thinner
    ones are drawn, so that short documents as well as long ones have subsets of few terms.
    Goes in steps so that nothing is computed twice.
    """
    steps = [f"{name}_{k}" for k in range(SPLITS + LEVELS)]
    rows = rows.withColumn(f"{name}_all", terms(text))
    rows = rows.withColumn(f"{name}_band", in_band(F.col(f"{name}_all"), words))
    used = F.when(F.size(f"{name}_band") < LEAST_TERMS, F.col(f"{name}_all")).otherwise(F.col(f"{name}_band"))
    rows = rows.withColumn(steps[0], F.array(used))
    for k, step in enumerate(steps[1:], 1):
        further = _split if k <= SPLITS else _thinned
        rows = rows.withColumn(step, further(F.col(steps[k - 1]), FIRST_BIT + 2 * k))
    rows = rows.withColumn(name, F.concat_ws("", *(_hashed(F.col(s)) for s in steps[SPLITS:])))
    return rows.drop(f"{name}_all", f"{name}_band", *steps)


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes of two fingerprints as a part of the subsets that are not empty on both sides.

    Takes the fingerprints as bytes, which are cut without counting characters. 1 for texts without
    any term, which are alike in that.
    """
    size = DIGITS // 2
    places = F.sequence(F.lit(1), F.lit(1 + size * (LEVELS * 4**SPLITS - 1)), F.lit(size))
    pairs = F.transform(places, lambda at: F.struct(*(F.substring(c, at, F.lit(size)).alias(n) for n, c in (("p", a), ("q", b)))))
    told = F.filter(pairs, lambda x: (x.p != x.q) | (x.p != F.unhex(F.lit(EMPTY))))
    return F.aggregate(
        told, F.struct(F.lit(0).alias("equal"), F.lit(0).alias("all")),
        lambda n, x: F.struct(
            (n["equal"] + F.when(x.p == x.q, 1).otherwise(0)).alias("equal"), (n["all"] + 1).alias("all")
        ),
        lambda n: F.when(n["all"] == 0, F.lit(1.0)).otherwise(n["equal"] / n["all"]),
    )


def fingerprints(docs: DataFrame, words: list[int] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``, the hashes of all subsets one after the other.

    ``words`` is the band of a corpus from :func:`band_words`, by default that of ``docs``.
    Equal texts have equal fingerprints; a null text counts as empty. A column of that name
    is replaced.
    """
    words = band_words(docs) if words is None else words
    held = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "fingerprint")).alias("r"), _text().alias("t"))
    made = with_hashes(held, F.col("t"), words, "h")
    return made.select("r.*", F.col("h").alias("fingerprint"))


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next``: a struct of the ``carried`` columns of the next document.

    Documents follow one another by ``doc_id``, nulls first, then by a hash of the text; after the last
    comes the first. They are dealt into ranges of about equal size by sampled boundaries,
    and the first document of each range also goes to the range before, so that a range knows
    what follows its last one. Each row is moved once. ``text`` must not be null.
    """
    keyed = rows.withColumns(
        {
            "_h": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))),
            "_id": F.xxhash64("text"),
            "_row": F.monotonically_increasing_id(),
            "_size": (F.octet_length("text") + ROW_BYTES).cast("bigint"),
        }
    )
    keys = keyed.select("_h", "_id", "_row", "_size")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    share = max(RANGE_BYTES, total / MOST_RANGES)
    bounds = quantiles(sample_keys(keys, share / SAMPLES), share) if total > share else []
    firsts = {
        r.n: tuple(r.first)
        for r in keys.groupBy(range_number(bounds).alias("n")).agg(F.min(F.struct("_h", "_id", "_row")).alias("first")).collect()
    }
    ranges = sorted(firsts)
    # The range before each range that holds anything; before the first comes the last.
    before = {n: ranges[k - 1] for k, n in enumerate(ranges)}
    table = np.zeros((4, len(bounds) + 1), np.int64)
    for n, first in firsts.items():
        table[:, n] = (*first, before[n])
    h, ident, row, previous = (
        F.get(F.from_json(F.lit(json.dumps(column.tolist())), "array<bigint>"), F.col("_n")) for column in table
    )
    is_first = (F.col("_h") == h) & (F.col("_id") == ident) & (F.col("_row") == row)
    places = F.when(is_first, F.array(F.struct(F.col("_n").alias("n"), F.lit(False).alias("guest")),
                                      F.struct(previous.cast("int").alias("n"), F.lit(True).alias("guest")))
                    ).otherwise(F.array(F.struct(F.col("_n").alias("n"), F.lit(False).alias("guest"))))
    dealt = keyed.withColumn("_n", range_number(bounds)).withColumn("_place", F.explode(places))
    dealt = dealt.repartition(max(len(bounds) + 1, 1), "_place.n")
    follows = F.lead(F.struct(*carried)).over(
        Window.partitionBy("_place.n").orderBy("_place.guest", "_h", "_id", "_row")
    )
    return dealt.withColumn("next", follows).filter(~F.col("_place.guest")).drop(
        "_h", "_id", "_row", "_size", "_n", "_place"
    )


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has its last quarter of code points, rounded down, replaced by as many
    (or all) of the first ones of the next document. Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``, the likeness to the next document. A null text counts as empty; a document
    alone is its own next one; repeated rows follow one another; an empty table gives no rows. Needs
    ``doc_id`` and ``text``, other columns are not looked at. Counts the document frequencies
    and samples the ranges when called.
    """
    words = band_words(docs, band)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text().alias("text"))
    placed = with_next(with_hashes(rows, F.col("text"), words, "own"), ["text", "own"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next.text", F.lit(1), quarter)
    )
    made = placed.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "own", F.col("next.own").alias("after"),
        edited.alias("edited"),
    )
    made = with_hashes(made, F.col("edited"), words, "other")
    made = made.withColumns({f"{c}_bytes": F.unhex(c) for c in ("own", "other", "after")})
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("other").alias("edited_fingerprint"),
        likeness(F.col("own_bytes"), F.col("other_bytes")).alias("near_edited"),
        likeness(F.col("own_bytes"), F.col("after_bytes")).alias("near_next"),
    )
