import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinity.llm import tries

DOCS = "doc_id bigint, lang string, text string"
LABELS = "doc_id bigint, quality int, toxic int"


@given(st.lists(st.tuples(st.text("abé", max_size=6), st.integers(-9, 9)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_trie_keeps_the_least_of_each_text(rows):
    trie, least = tries.RadixTrie(), {}
    ends = []
    for text, number in rows:
        key = text.encode()
        ends.append((trie.insert(key, number), key))
        least[key] = min(number, least.get(key, number))
    assert list(trie.terminals()) == sorted(least.items())
    assert all(trie.least[end] == least[key] for end, key in ends)
    # compressed: a node without a terminal divides
    assert all(len(b) > 1 or n == 0 or trie.least[n] is not None for n, b in enumerate(trie.below))


def fails(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text))


def masks_of(docs):
    least = {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = Counter()
    for i, lang, text in docs:
        first = least.get(text or "")
        twice = first is not None and (i is None or i > first)
        bits = (*fails(text or ""), twice)
        out[i, lang or "", sum(1 << k for k, b in enumerate(bits) if b)] += 1
    return out


def audit_of(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for (i, part, mask), n in masks_of(docs).items():
        for order in itertools.permutations(range(5)):
            for step in range(5):
                row = out.setdefault((part, "".join("ABCDE"[f] for f in order), step + 1), [0] * 7)
                gone = any(mask >> f & 1 for f in order[:step])
                failed = mask >> order[step] & 1
                row[0] += n * (not gone and not failed)
                row[1] += n * (failed and not gone)
                row[2] += n * (failed and gone)
                row[3] += n * (mask == 1 << order[step])
                row[4] += n * (failed and not gone and i in good)
                row[5] += n * (failed and not gone and i in toxic)
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {(k, *row[:6], shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def texts_of(seed, many):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(150)] + ["É", "日本語", "A" * 9]
    texts = [" ".join(draw.choices(words, k=draw.choice((3, 40, 120, 300)))) for _ in range(many)]
    texts += [t + draw.choice(("$", " more", " ", "\n")) for t in texts] + [None, "", " ", "ABC", "x" * 70000]
    return texts


@pytest.fixture(scope="module")
def docs():
    draw, texts = random.Random(1), texts_of(2, 60)
    rows = [(k, draw.choice(("en", "fr", None, "")), draw.choice(texts)) for k in range(500)]
    rows += [(None, "en", texts[0]), (None, None, texts[0]), (3, "de", texts[1]), (3, "de", texts[1]), (None, "en", "only here")]
    return rows


def found(df):
    return Counter({(r.doc_id, r.part, r.mask): r["count"] for r in df.groupBy("doc_id", "part", "mask").count().collect()})


@pytest.mark.parametrize("weight", [tries.GROUP_WEIGHT, 20000, 5000])
def test_masks_whatever_the_ranges(spark, docs, weight):
    rows = spark.createDataFrame(docs, DOCS)
    assert found(tries.failures(rows, weight)) == masks_of(docs)
    if weight == 20000:
        ranges, _ = tries.lay_out(rows.select(F.coalesce("text", F.lit("")).alias("text")), weight)
        assert len(ranges.starts) > 5 and ranges.starts == sorted(set(ranges.starts))


def test_a_text_of_a_third_of_all_rows_is_not_moved(spark):
    rows = [(k, "en", "the same long text " * 30 if k % 3 else f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    plan = tries.failures(df)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
    assert found(plan) == masks_of(rows)


def test_long_shared_prefixes_are_divided_by_hash(spark):
    rows = [(k, "en", "p" * 2000 + str(k % 400)) for k in range(1200)]
    df = spark.createDataFrame(rows, DOCS)
    ranges, _ = tries.lay_out(df.select("text"), 100_000)
    assert max(ranges.parts) > 3
    assert found(tries.failures(df, 100_000)) == masks_of(rows)


def test_prefixes():
    assert tries._shortest_after("", "abc") == "a"
    assert tries._shortest_after("abc", "abd") == "abd"
    assert tries._shortest_after("ab", "abcd") == "abc"


def test_audit(spark, docs):
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 500, 3)] + [(6, 1, 0), (9, None, None), (None, 1, 1), (10**6, 1, 1)]
    clash = spark.createDataFrame(docs, DOCS).withColumns({n: F.lit(7) for n in (
        "part", "mask", "range", "deal", "least", "n", "good", "toxic", "step", "filter_order", "count")})
    got = tries.filter_audit(clash, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    assert {((r.part, r.filter_order, r.step), *r[3:]) for r in got.collect()} == audit_of(docs, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert tries.filter_audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], DOCS)
    assert {((r.part, r.filter_order, r.step), *r[3:]) for r in tries.filter_audit(one, labels).collect()} == audit_of(
        [(1, None, None)], [])
