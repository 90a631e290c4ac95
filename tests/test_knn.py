import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.util import chunks_of

from vicinity.operators import knn
from vicinity.operators.knn import knn_chunks, rows_in_reach


def brute(queries, index, k, min_score=0.0):
    """``{query: [(path, chunk, score)]}`` from plain loops."""
    out = {}
    for qid, banned, q in queries:
        q = np.asarray(q, float)
        found = []
        for path, i, x in index:
            x = np.asarray(x, float)
            size = np.sqrt(q @ q) * np.sqrt(x @ x)
            if path in banned or size == 0:
                continue
            score = round(float(q @ x / size), 12) + 0.0
            if score >= min_score:
                found.append((-score, path, i))
        out[qid] = [(p, i, -s) for s, p, i in sorted(found)[:k]]
    return {q: hits for q, hits in out.items() if hits}


def run(spark, queries, index, k, plan, min_score=0.0, per_block=None, many=False):
    column = "exclude_paths array<string>" if many else "exclude_path string"
    asked = spark.createDataFrame(
        [(q, list(b) if many else (b[0] if b else None), [float(x) for x in v]) for q, b, v in queries],
        f"query_id string, {column}, embedding array<float>",
    )
    hits = knn_chunks(asked, chunks_of(spark, *index), k, min_score, plan, per_block, cell_rows=10)
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.path, r.chunk_index, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [h[:2] for h in got[q]] == [h[:2] for h in want[q]]
        assert np.allclose([h[2] for h in got[q]], [h[2] for h in want[q]], atol=1e-11)


def data(seed, notes, chunks, dim):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [
        (f"n{n:03}.md", c, np.float32(centers[(n + c) % 6] + 0.4 * rng.normal(size=dim)).tolist())
        for n in range(notes)
        for c in range(chunks)
    ]


PLANS = ("broadcast", "cells", "bounds")


@pytest.mark.parametrize("plan", PLANS)
def test_against_all_pairs(spark, plan):
    index = data(1, 40, 4, 8)
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index]
    same(run(spark, queries, index, 7, plan, per_block=25), brute(queries, index, 7))


@pytest.mark.parametrize("plan", PLANS)
def test_integer_vectors_with_many_ties(spark, plan):
    rng = np.random.default_rng(2)
    index = [(f"n{n:02}.md", c, rng.integers(-1, 2, 4).tolist()) for n in range(25) for c in range(4)]
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index]
    same(run(spark, queries, index, 5, plan, per_block=20), brute(queries, index, 5))


@pytest.mark.parametrize("plan", PLANS)
def test_a_third_of_all_rows_are_copies(spark, plan):
    index = data(3, 30, 3, 6)
    copy = [0.3, -0.1, 0.7, 0.2, 0.0, 0.5]
    index += [(f"copy{n:02}.md", c, copy) for n in range(15) for c in range(2)]
    index += [("huge.md", c, copy) for c in range(30)]
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index]
    same(run(spark, queries, index, 4, plan, per_block=16), brute(queries, index, 4))


def test_copies_are_cut_to_those_in_reach(spark):
    index = [("big.md", c, [1, 2]) for c in range(50)] + [(f"n{n}.md", 0, [1, 2]) for n in range(50)]
    kept = rows_in_reach(chunks_of(spark, *index), 3, 1).select("path", "chunk_index").collect()
    assert {tuple(r) for r in kept} == {
        ("big.md", 0), ("big.md", 1), ("big.md", 2), ("n0.md", 0), ("n1.md", 0), ("n10.md", 0)}


@pytest.mark.parametrize("plan", PLANS)
def test_one_note_holds_most_chunks(spark, plan):
    index = data(4, 12, 2, 5) + [("huge.md", c, v) for c, (_, _, v) in enumerate(data(5, 60, 1, 5))]
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index]
    same(run(spark, queries, index, 6, plan, per_block=10), brute(queries, index, 6))


@pytest.mark.parametrize("plan", PLANS)
def test_exclusion_lists_come_before_the_cut(spark, plan):
    index = data(6, 20, 3, 5) + [("n000.md", 9, None)]
    usable = [i for i in index if i[2]]
    queries = [(f"{p}/{i}", [f"n{n:03}.md" for n in range(int(p[1:4]), int(p[1:4]) + 5)], v)
               for p, i, v in usable]
    same(run(spark, queries, index, 4, plan, per_block=12, many=True), brute(queries, usable, 4))


@pytest.mark.parametrize("plan", PLANS)
def test_zero_and_negative(spark, plan):
    index = [("a.md", 0, [1, 0]), ("b.md", 0, [0, 1]), ("c.md", 0, [-1, 0.1]), ("z.md", 0, [0, 0])]
    queries = [("q", (), [2, 0]), ("zero", (), [0, 0])]
    assert run(spark, queries, index, 9, plan) == {"q": [("a.md", 0, 1.0), ("b.md", 0, 0.0)]}
    got = run(spark, queries, index, 9, plan, min_score=-1.0)["q"]
    assert [h[0] for h in got] == ["a.md", "b.md", "c.md"]
    got = run(spark, queries, index, 9, plan, min_score=0.5)["q"]
    assert [h[0] for h in got] == ["a.md"]


@pytest.mark.parametrize("plan", PLANS)
def test_empty_sides(spark, plan):
    index = data(7, 3, 1, 4)
    assert run(spark, [], index, 3, plan) == {}
    assert run(spark, [("q", (), [1, 0, 0, 0])], [], 3, plan) == {}


def test_vectors_need_not_be_unit_length(spark):
    index = [("a.md", 0, [10, 0]), ("b.md", 0, [1, 1])]
    got = run(spark, [("q", (), [0.5, 0.5])], index, 2, "auto")["q"]
    assert [h[0] for h in got] == ["b.md", "a.md"]


def test_auto_checks_the_size(spark, monkeypatch):
    index = data(8, 30, 2, 6)
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index]
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(knn, "MIN_BLOCK_ROWS", 8)
    same(run(spark, queries, index, 3, "auto"), brute(queries, index, 3))
    with pytest.raises(ValueError):
        run(spark, queries, index, 3, "broadcast")
    with pytest.raises(ValueError):
        run(spark, queries, index, 3, "other")


def test_a_query_moves_once_for_each_block_not_for_each_cell(spark, monkeypatch):
    rng = np.random.default_rng(10)
    index = [(f"n{n:03}.md", 0, rng.normal(size=16).tolist()) for n in range(200)]
    queries = [(p, (p,), v) for p, _, v in index]
    moved, inner = [], knn.best_by_block

    def spy(asked, held, *more):
        moved.append((asked.count(), held.count()))
        return inner(asked, held, *more)

    monkeypatch.setattr(knn, "best_by_block", spy)
    # Twenty cells of ten rows, none of which can be left out, in four or five blocks.
    same(run(spark, queries, index, 5, "cells", min_score=-1.0, per_block=50),
         brute(queries, index, 5, min_score=-1.0))
    assert sum(asked for asked, _ in moved) <= 200 * 8


def test_a_block_is_bounded_and_grows_slower_than_the_table(spark):
    assert knn._block_rows(10_000, 10_000, 64, 12) < 1100
    assert knn._block_rows(10**6, 10**6, 64, 12) == knn._block_rows(10**7, 10**7, 64, 12) == 1 << 15
    assert knn._block_rows(10**6, 10**6, 1 << 14, 12) == knn.MIN_BLOCK_ROWS


def test_scores_closer_than_single_precision_keep_their_order(spark):
    index = [(f"n{n:03}.md", 0, [1.0, float(np.float32(n * 1e-4))]) for n in range(60)]
    queries = [("q", (), [1.0, 0.0])]
    for plan in PLANS:
        same(run(spark, queries, index, 3, plan), brute(queries, index, 3))


def test_plan_has_no_cross_join(spark):
    index = chunks_of(spark, *data(9, 20, 2, 6))
    queries = index.select(F.col("path").alias("query_id"), F.col("path").alias("exclude_path"), "embedding")
    for plan in PLANS:
        text = knn_chunks(queries, index, 3, plan=plan)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text
        assert "WindowGroupLimit" in text


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("tile, reach", [(3, False), (8, True), (1024, True)])
def test_tiles_give_what_whole_lines_give(monkeypatch, k, tile, reach):
    monkeypatch.setattr(knn, "TILE_ROWS", tile)
    monkeypatch.setattr(knn, "SCORE_CELLS", 64)
    product, widths = knn._product, []

    def watched(queries, rows, blank):
        widths.append(len(rows))
        return product(queries, rows, blank)

    monkeypatch.setattr(knn, "_product", watched)
    index = data(3, 21, 3, 6) + [("zero.md", 0, [0.0] * 6), ("zz.md", 0, [1.0] * 6), ("zz.md", 1, [1.0] * 6)]
    asked = [(f"q{i}", (p,) if i % 2 else (), v) for i, (p, _, v) in enumerate(index)]
    want = brute(asked, index, k)
    rows = knn.pa.table(
        [[p for p, _, _ in index], knn.pa.array([c for _, c, _ in index], knn.pa.int32()), [v for _, _, v in index]],
        names=["path", "chunk_index", "embedding"],
    )
    columns = {"query_id": [q for q, _, _ in asked], "exclude_paths": [list(b) for _, b, _ in asked],
               "embedding": [v for _, _, v in asked]}
    if reach:
        columns["reach"] = [want[q][-1][2] if len(want.get(q, [])) == k else None for q, _, _ in asked]
        columns["reach"] = knn.pa.array(columns["reach"], knn.pa.float64())
    got = {}
    for r in knn._hits(knn.pa.table(columns), rows, ["query_id"], k, 0.0).to_pylist():
        got.setdefault(r["query_id"], []).append((r["path"], r["chunk_index"], r["score"]))
    same(got, want)
    assert max(widths) <= max(tile, -(-len(index) // knn.SAMPLED))
