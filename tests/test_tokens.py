import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinity.functions.tokens import (
    bisect_prefix,
    check_token_limit,
    chunk_size,
    chunk_token_profile,
    count_tokens,
    piece_counter,
    python_counter,
    truncate_to_tokens,
    utf16_length,
)

TEXTS = ["", "a", "ab", "abc", "aé한😀", "안녕", "aaaaé", "aaaaaé", "éééé", "😀" * 5, "x" * 50 + "é" * 10]


@pytest.mark.parametrize("counter", ["bytes", "ascii"])
def test_column_and_python_counts_agree(spark, counter):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(count_tokens("t", counter)).collect()]
    assert got == [python_counter(counter)(t) for t in TEXTS]


def test_known_counts(spark):
    count = python_counter("bytes")
    assert [count(t) for t in ("", "a", "ab", "abc", "안녕")] == [0, 1, 1, 2, 3]
    count = python_counter("ascii")
    # exactly 80 % ASCII is not mostly ASCII
    assert [count(t) for t in ("", "aaaa", "aaaaa", "aaaaé", "aaaaaé", "😀")] == [0, 1, 2, 5, 2, 2]
    assert spark.range(1).select(utf16_length(F.lit("aé한😀"))).first()[0] == 5


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_piece_counts(text, cuts):
    bounds = np.array(sorted({0, len(text), *[min(c, len(text)) for c in cuts]}))
    for counter in ("bytes", "ascii"):
        want = [python_counter(counter)(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        assert piece_counter(counter)(text, bounds).tolist() == want


def test_user_counter_and_nulls(spark, table):
    df = table("t string", ("a b",), (None,), ("",))
    out = df.select(count_tokens("t", lambda texts: [len(t.split()) for t in texts]))
    assert [r[0] for r in out.collect()] == [2, None, 0]
    with pytest.raises(ValueError):
        count_tokens("t", "words")


def test_limit(table):
    out = check_token_limit(table("text string", ("abcd",), ("abcde",)), 2).collect()
    assert [(r.token_count, r.max_tokens, r.is_over_limit) for r in out] == [
        (2, 2, False), (3, 2, True)]


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 40])
@pytest.mark.parametrize("counter", ["bytes", "ascii"])
def test_truncation_equals_the_search(spark, counter, limit):
    texts = [*TEXTS, "ab😀cd", "é😀" * 9, "한글한글", "�" * 4]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(truncate_to_tokens("t", limit, counter)).collect()]
    assert got == [bisect_prefix(t, limit, python_counter(counter)) for t in texts]


def test_chunk_sizes(table):
    models = table(
        "model string, detected int, context int",
        ("a", 512, 512), ("b", 2048, 8192), ("c", 512, None), ("d", 512, 0), ("e", 256, None),
        ("f", 512, 301),
    )
    got = {r.model: (r.max_tokens, r.chunk_size) for r in chunk_size(models).collect()}
    assert got == {"a": (256, 256), "b": (2048, 512), "c": (512, 512), "d": (512, 512),
                   "e": (256, 256), "f": (150, 150)}


def test_profile(table):
    chunks = table("path string, content string", ("a", "xx"), ("a", "xxxx"), ("a", "x" * 9), ("b", ""))
    got = {r.path: tuple(r)[1:] for r in chunk_token_profile(chunks).collect()}
    assert got == {"a": (3, 1, 5, 8, 2), "b": (1, 0, 0, 0, 0)}
