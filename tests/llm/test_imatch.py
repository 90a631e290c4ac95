import hashlib
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import imatch

DOCS = "doc_id bigint, text string"


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def term_hashes(text):
    return {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def hashes(text, slots):
    """All subsets, each term looked at by itself."""
    terms = term_hashes(text)
    used = {t for t in terms if t % imatch.SLOTS in slots}
    used = terms if len(used) < imatch.LEAST_TERMS else used
    out = []
    for level in range(imatch.LEVELS):
        for part in range(4**imatch.SPLITS):
            bits = [part // 4 ** (imatch.SPLITS - k) % 4 for k in range(1, imatch.SPLITS + 1)] + [0] * level
            subset = sorted(t for t in used if all(
                (t >> imatch.FIRST_BIT + 2 * k) % 4 == b for k, b in enumerate(bits, 1)))
            h = 42
            for t in subset:
                h = xxhash.xxh64(struct.pack("<q", t), seed=h).intdigest()
            out.append(f"{signed(h) % 65535 + 1:04x}" if subset else "0000")
    return out


def band(texts, low=imatch.BAND[0], high=imatch.BAND[1]):
    df = Counter(s for t in texts for s in {h % imatch.SLOTS for h in term_hashes(t)})
    return {s for s, n in df.items() if len(texts) ** (1 - high) <= n <= len(texts) ** (1 - low)}


def brute(rows):
    slots = band([t or "" for _, t in rows])
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()))
    rows = sorted(rows, key=key)
    out = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, other, follows = hashes(text, slots), hashes(edited, slots), hashes(after, slots)

        def near(a, b):
            told = [p == q for p, q in zip(a, b) if (p, q) != ("0000", "0000")]
            return round(sum(told) / len(told), 9) if told else 1.0

        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), near(own, other), near(own, follows)] += 1
    return out


def found(df):
    return Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in imatch.compare_edited(df).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = [f"word{k}" for k in range(400)] + ["Éa", "日本", "x😀y", "don't"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(draw.choices(words, weights, k=draw.choice((0, 3, 30, 120)))) for _ in range(120)]
    out = [(k * 3, draw.choice(texts)) for k in range(300)]
    return out + [(None, texts[0]), (None, "null id"), (5, None), (7, ""), (9, texts[3]), (9, texts[4]), (9, texts[4]), (11, "long" * 30000)]


@pytest.mark.parametrize("size", [imatch.RANGE_BYTES, 20000, 2000])
def test_against_brute_force(spark, monkeypatch, rows, size):
    monkeypatch.setattr(imatch, "RANGE_BYTES", size)
    draw = rows[:]
    random.Random(size).shuffle(draw)
    df = spark.createDataFrame(draw, DOCS).repartition(5)
    assert found(df) == brute(rows)


def test_many_rows_of_one_identifier(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 4000)
    many = [(7, f"text number {k} of one identifier") for k in range(300)] + [(8, "end")] + [(None, "same")] * 100
    assert found(spark.createDataFrame(many, DOCS)) == brute(many)


def test_one_and_none(spark):
    assert found(spark.createDataFrame([], DOCS)) == Counter()
    for rows in ([(1, "alone here")], [(1, None)], [(1, "a b c d"), (2, "")]):
        assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_fingerprints_keep_columns(spark, rows):
    clash = ("t", "r", "h", "own", "next", "_h", "_id", "_row", "_n", "_size", "h_0", "h_all", "fingerprints")
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(c), "doc_id") for c in clash})
    got = imatch.fingerprints(df)
    assert got.columns == [*df.columns, "fingerprint"]
    seen = {}
    for r in got.collect():
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in clash)
        assert seen.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert Counter(tuple(r) for r in imatch.compare_edited(df).select("doc_id", "fingerprint").collect()) == Counter(
        (r.doc_id, r.fingerprint) for r in got.collect())


def test_no_python_in_the_plan(spark, rows):
    plan = imatch.compare_edited(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_an_edit_stays_nearer_than_another_document(spark, rows):
    draw = random.Random(9)
    docs = [(k, " ".join(f"w{draw.randint(0, 3000)}" for _ in range(200))) for k in range(200)]
    got = imatch.compare_edited(spark.createDataFrame(docs, DOCS)).collect()
    assert sum(r.near_edited > r.near_next + 0.1 for r in got) > 190
