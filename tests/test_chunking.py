import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.util import notes_of

from vicinity.functions.tokens import python_counter
from vicinity.operators.chunking import SEPARATORS, TRIMMED, Splitter, chunk_notes, chunk_size_sweep
from vicinity.operators.embedding import HashEmbedder


def chars(texts):
    return [len(t) for t in texts]


def by_steps(text, size, overlap, count):
    """The split as a plain loop: pieces one by one, window shrunk one by one."""
    def merge(pieces):
        out, held = [], []
        for piece in pieces:
            if held and sum(map(count, held)) + count(piece) > size:
                out.append("".join(held))
                while sum(map(count, held)) > 0 and (
                    sum(map(count, held)) > overlap
                    or sum(map(count, held)) + count(piece) > size
                ):
                    held.pop(0)
            held.append(piece)
        out.append("".join(held))
        return [c.strip(TRIMMED) for c in out if c.strip(TRIMMED)]

    def split(part, separators):
        while separators[0] not in part:
            separators = separators[1:]
        first = separators[0]
        pieces = list(part) if not first else [
            p for p in re.split(f"(?={re.escape(first)})", part) if p
        ]
        out, run = [], []
        for piece in pieces:
            if count(piece) < size:
                run.append(piece)
                continue
            out += merge(run)
            run = []
            out += split(piece, separators[1:]) if len(separators) > 1 else [piece]
        return out + merge(run)

    return split(text, SEPARATORS)


PARTS = st.sampled_from(
    ["\n## ", "\n### ", "\n", "\n\n", "\n\n\n", " ", "  ", "word", "é한", "😀", "```\n\n", "\n\n---\n\n",
     "longerword", "\n\n***\n\n", "# ", "x" * 30, " "]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.integers(6, 40), st.integers(0, 5))
def test_equals_the_plain_loop(text, size, overlap):
    for counter in ("bytes", "ascii"):
        want = by_steps(text, size, overlap, python_counter(counter))
        assert Splitter(size, overlap, counter).split(text) == want
    assert Splitter(size, overlap, chars).split(text) == by_steps(text, size, overlap, len)


def test_markdown_levels():
    text = "Intro line\n## One\nbody one\n## Two\nbody two"
    assert Splitter(20, 5, chars).split(text) == ["Intro line", "## One\nbody one", "## Two\nbody two"]
    code = "text\n```\ncode\n```\n\nafter the code\n\n---\n\nlast part"
    assert Splitter(24, 0, chars).split(code) == ["text\n```\ncode", "```\n\nafter the code", "---\n\nlast part"]


def test_overlap_is_carried():
    assert Splitter(10, 4, chars).split("aa bb cc dd ee ff") == ["aa bb cc", "cc dd ee", "ee ff"]


PARAGRAPHS = "\n\n".join(f"Paragraph {i}. " + "lorem ipsum dolor sit amet " * 4 for i in range(40))


def test_model_limits(spark):
    notes = notes_of(spark, ("n.md", PARAGRAPHS))
    counts = {}
    for size in (512, 256):
        got = chunk_notes(notes, size, counter=chars).orderBy("chunk_index").collect()
        assert len(got) > 1 and all(len(r.content) <= size for r in got)
        assert [r.chunk_index for r in got] == list(range(len(got)))
        assert {r.total_chunks for r in got} == {len(got)}
        counts[size] = len(got)
    assert counts[256] > counts[512]


def test_short_and_empty_notes(spark):
    notes = notes_of(spark, ("a.md", "Just a short note."), ("b.md", ""), ("c.md", None), ("d.md", " \n "))
    got = chunk_notes(notes).collect()
    assert [(r.path, r.content, r.chunk_index, r.total_chunks) for r in got] == [
        ("a.md", "Just a short note.", 0, 1)]


def test_overlap_must_be_smaller_than_the_size(spark):
    with pytest.raises(ValueError):
        chunk_notes(notes_of(spark, ("a.md", "x")), chunk_size=100)


def test_spread_gives_the_same_rows(spark):
    notes = notes_of(spark, *[(f"{i}.md", PARAGRAPHS[: i * 40]) for i in range(30)])
    plain = {tuple(r) for r in chunk_notes(notes).collect()}
    assert {tuple(r) for r in chunk_notes(notes, partitions=5).collect()} == plain


def test_sweep_against_all_pairs(spark):
    import numpy as np

    notes = notes_of(spark, ("a.md", PARAGRAPHS), ("b.md", PARAGRAPHS[500:2500] + " other words"),
                     ("c.md", "something else entirely"))
    pairs = spark.createDataFrame([("a.md", "b.md"), ("a.md", "c.md"), ("a.md", "b.md")], "src string, dst string")
    got = {(r["size"], r["src"], r["dst"]): r["score"]
           for r in chunk_size_sweep(notes, pairs, HashEmbedder(64), sizes=(256, 128)).collect()}
    embedder = HashEmbedder(64)
    for size in (256, 128):
        made = {}
        for row in chunk_notes(notes, size).collect():
            text = f"{row.title}\n\n{row.content}" if row.chunk_index == 0 else row.content
            made.setdefault(row.path, []).append(embedder.embed_texts([text])[0].astype(np.float32))
        for src, dst in (("a.md", "b.md"), ("a.md", "c.md")):
            best = max(float(x @ y) for x in made[src] for y in made[dst])
            assert got[(size, src, dst)] == pytest.approx(best, abs=1e-5)
    assert len(got) == 4
