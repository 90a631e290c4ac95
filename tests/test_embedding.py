import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinity.functions.vectors import cosine, normalize, pool_normalize, validate_chunks
from vicinity.operators import embedding
from vicinity.operators.embedding import (
    EmbeddingError,
    HashEmbedder,
    PayloadPacker,
    RemoteEmbedder,
    _embed_isolating,
    batches_of,
    embed_column,
    ordered_vectors,
    payload_batches,
    probe_dim,
    sliced,
    split_into_batches,
)


def test_batches():
    assert batches_of([1, 2], 5) == [[1, 2]]
    assert batches_of([1, 2], 2) == [[1, 2]]
    assert batches_of([1, 2, 3], 2) == [[1, 2], [3]]
    assert batches_of([], 2) == []
    for n in (0, -1, 1.5, True, "2"):
        with pytest.raises(ValueError):
            batches_of([1], n)


@pytest.mark.parametrize(
    "texts, budget, want",
    [
        (["x" * n for n in (3, 3, 2, 5, 1, 9)], 8, [0, 0, 0, 1, 1, 2]),
        (["é" * 4, "z" * 30, "é", "zz"], 9, [0, 1, 2, 2]),
        ([f"part {i}" for i in range(40)], 25, None),
        (["漢字", "漢", "ab", "cc"], 6, [0, 1, 1, 2]),
        (["", "", "a"], 1, [0, 0, 0]),
    ],
)
def test_payload_batches(table, texts, budget, want):
    chunks = table("path string, chunk_index int, content string",
                   *[(p, i, t) for p in ("a", "b") for i, t in enumerate(texts)])
    got = payload_batches(chunks, budget).orderBy("path", "chunk_index").collect()
    numbers = [r.batch_no for r in got if r.path == "a"]
    assert numbers == [r.batch_no for r in got if r.path == "b"]
    if want is None:  # order kept and every batch within the budget
        sizes = {}
        for text, n in zip(texts, numbers):
            sizes[n] = sizes.get(n, 0) + len(text)
        assert numbers == sorted(numbers) and all(s <= budget for s in sizes.values())
    else:
        assert numbers == want


def test_split_into_batches(table):
    chunks = table("path string, chunk_index int", *[(p, i) for p in "ab" for i in range(5)])
    got = {(r.path, r.chunk_index): r.batch_no for r in split_into_batches(chunks, 2).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 1, 2] == [got["b", i] for i in range(5)]


def test_response_checks():
    assert ordered_vectors([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    with pytest.raises(EmbeddingError):
        ordered_vectors([[1.0]], 2)
    with pytest.raises(EmbeddingError):
        ordered_vectors(["x", "y"], 2)


class Counting(HashEmbedder):
    """Notes the sizes of its calls in the first cell; fails on some texts."""

    def embed_texts(self, texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no good")
        out = super().embed_texts(texts)
        for vector in out:
            vector[0] = len(texts)
        return out


def test_embed_column_batches_and_isolates(spark):
    df = spark.createDataFrame([(i, "bad" if i == 5 else f"word{i}") for i in range(10)], "i int, t string")
    out = embed_column(df.coalesce(1), "t", Counting(16), batch_size=4).orderBy("i").collect()
    assert [r.error for r in out] == [None] * 5 + ["no good"] + [None] * 4
    assert out[5].embedding is None
    assert [int(r.embedding[0]) for r in out if r.i != 5] == [4] * 4 + [1, 2, 2] + [2, 2]
    with pytest.raises(ValueError):
        embed_column(df, "t", Counting(16), batch_size=0)
    assert embed_column(df, "t", HashEmbedder(8), partitions=3).count() == 10


def test_remote_requests_stay_within_the_budget(spark):
    requests = []

    def transport(texts):
        requests.append(list(texts))
        return [[float(len(t))] for t in texts]

    remote = RemoteEmbedder(transport, 1, 100, budget=8)
    assert remote.embed_texts(["aaaa", "bbb", "cc", "d" * 20]) == [[4.0], [3.0], [2.0], [20.0]]
    assert requests == [["aaaa", "bbb"], ["cc"], ["d" * 20]]
    df = spark.createDataFrame([("x",), ("yy",)], "t string")
    local = RemoteEmbedder(lambda texts: [[float(len(t))] for t in texts], 1, 100)
    assert sorted(r.embedding for r in embed_column(df, "t", local).collect()) == [[1.0], [2.0]]


def test_probe_and_hash_embedder():
    class Silent:
        def embed_texts(self, texts):
            return [[0.0] * 7 for _ in texts]

    assert probe_dim(Silent()) == 7 and probe_dim(HashEmbedder(12)) == 12
    a, b, c = HashEmbedder(32).embed_texts(["Red apple", "red  APPLE", ""])
    assert a.tolist() == b.tolist() and abs((a @ a) - 1) < 1e-12 and not c.any()
    packer = PayloadPacker(3)
    assert [packer.place(n) for n in (3, 0, 1)] == [0, 0, 1]


def test_vectors(spark, table):
    df = table("v array<float>, w array<float>", ([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]))
    out = df.select(normalize("v").alias("n"), cosine("v", "w").alias("c")).collect()
    assert out[0].n == pytest.approx([0.6, 0.8]) and out[0].c == pytest.approx(0.96)
    assert out[1].n == [0.0, 0.0] and out[1].c is None
    tokens = table("k string, embedding array<float>", ("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 0.0]))
    got = {r.k: r.embedding for r in pool_normalize(tokens, "k").collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["b"] == [1.0, 0.0]


def test_validate(table):
    chunks = table("path string, chunk_index int, embedding array<float>", ("a", 0, [1.0, 2.0]), ("a", 1, None),
                   ("b", 0, []), ("b", 1, [1.0]))
    valid, rejected = validate_chunks(chunks, 2)
    assert [r.path for r in valid.collect()] == ["a"]
    assert {(r.path, r.chunk_index): r.reason for r in rejected.collect()} == {
        ("a", 1): "missing", ("b", 0): "empty", ("b", 1): "size_mismatch"}


def test_bad_texts_fail_alone_and_an_outage_is_one_call():
    class Counting(HashEmbedder):
        calls, down = 0, False

        def embed_texts(self, texts):
            self.calls += 1
            if self.down:
                raise ConnectionError("no answer")
            if "bad" in texts:
                raise ValueError("refused")
            return super().embed_texts(texts)

    model, texts = Counting(8), ["fine"] * 31 + ["bad"]
    vectors, errors = _embed_isolating(model, texts, 32)
    assert errors == [None] * 31 + ["refused"] and [v is None for v in vectors] == [False] * 31 + [True]
    assert model.calls == 11
    model.calls, model.down = 0, True
    assert _embed_isolating(model, texts, 32) == ([None] * 32, ["no answer"] * 32) and model.calls == 1


def test_large_arrow_batches_are_taken_in_slices():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(n))}) for n in (0, 10, 3)]
    parts = [p.column("n").to_pylist() for p in sliced(batches, 4)]
    assert parts == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2]]


def test_slices_keep_the_batches_of_the_model(spark, monkeypatch):
    class Sized:
        """Says how many texts it was asked about at once."""

        dim, max_tokens = 1, 512

        def embed_texts(self, texts):
            return [[float(len(texts))] for _ in texts]

    monkeypatch.setattr(embedding, "CHUNKS_AT_ONCE", 7)
    df = spark.range(20, numPartitions=1).select(F.col("id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("t"))
    rows = embed_column(df, "t", Sized(), batch_size=3).orderBy("id").collect()
    assert [r.embedding[0] for r in rows] == [3.0] * 18 + [2.0] * 2


def test_rows_with_a_vector_keep_it(table):
    rows = [(f"w{i}", [float(i)] * 4 if i % 3 else None) for i in range(40)]
    rows += [("empty", [])]
    df = table("t string, embedding array<float>", *rows).coalesce(1)
    got = {r.t: r for r in embed_column(df, "t", HashEmbedder(4), batch_size=2, missing_only=True).collect()}
    for text, vector in rows:
        want = HashEmbedder(4).embed_texts([text])[0].tolist() if vector is None else vector
        assert got[text].embedding == pytest.approx(want) and got[text].error is None

    def fail(texts):
        raise RuntimeError("down")

    broken = embed_column(df, "t", RemoteEmbedder(fail, 4, 9), missing_only=True).collect()
    assert {r.t: r.error for r in broken} == {t: "down" if v is None else None for t, v in rows}
    assert all((r.embedding is None) == (r.error is not None) for r in broken)
