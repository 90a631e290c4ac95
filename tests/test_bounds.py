"""The bounds of compressed vectors, and the plan that rests on them."""

import numpy as np
import pyarrow as pa
import pytest
from tests.test_knn import brute, data, run, same
from tests.util import chunks_of

from vicinity.operators import bounds


def compressed(spark, vectors):
    rows = bounds.compress(chunks_of(spark, *[("a.md", i, v) for i, v in enumerate(vectors)]))
    return {r.chunk_index: (np.frombuffer(r.code, np.int8), r.scale, r.slack) for r in rows.collect()}


@pytest.mark.parametrize("dim", [1, 3, 64, 1100])
def test_scores_lie_within_their_bounds(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = np.float32(rng.standard_t(2, size=(40, dim))).tolist()
    kept = compressed(spark, vectors)
    units = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    assert sorted(kept) == list(range(40))
    for i in kept:
        for j in kept:
            (a, s, e), (b, t, f) = kept[i], kept[j]
            middle = float(a.astype(int) @ b.astype(int)) * s * t
            assert abs(units[i] @ units[j] - middle) <= f + e * (1 + f) + 1e-12


def test_what_never_matches_is_left_out(spark):
    kept = compressed(spark, [[1, 2], [0, 0], None, [], [float("nan"), 1], [float("inf"), 1]])
    assert list(kept) == [0]


def test_hits_that_differ_by_less_than_the_bounds(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=16)
    index = [(f"n{n:03}.md", 0, (base + 10.0 ** -(n % 9) * rng.normal(size=16)).tolist()) for n in range(200)]
    index = [(p, c, np.float32(v).tolist()) for p, c, v in index]
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index[::5]]
    same(run(spark, queries, index, 3, "bounds", per_block=30), brute(queries, index, 3))


def test_a_crowded_query_gives_one_line_and_goes_on_in_cells(spark, monkeypatch):
    monkeypatch.setattr(bounds, "CROWD", 2)
    crowd = [(f"c{n:03}.md", 0, [1.0, 1e-4 * n, 0.0]) for n in range(120)]
    index = crowd + data(12, 30, 1, 3)
    queries = [("in", (), [1.0, 0.003, 0.0]), ("out", (), [-0.2, 0.1, 1.0]), ("zero", (), [0.0, 0.0, 0.0])]
    same(run(spark, queries, index, 4, "bounds", per_block=40), brute(queries[:2], index, 4))


def test_candidates_stay_few(spark):
    """Vectors without clusters: the bounds leave a few pairs for each of the k hits."""
    rng = np.random.default_rng(13)
    units = np.float32(rng.normal(size=(3000, 64))).tolist()
    kept = compressed(spark, units)
    table = pa.table({
        "code": [kept[i][0].tobytes() for i in kept], "scale": [kept[i][1] for i in kept],
        "slack": [kept[i][2] for i in kept], "_row": list(kept)})
    asked = table.slice(0, 200).rename_columns(["code", "scale", "slack", "_query"])
    found = bounds._candidates(asked, table, 15, -1.0)
    assert 200 * 15 <= found.num_rows < 200 * 60
    assert found.column("_row").null_count == 0


def test_rows_near_to_many_queries(spark, monkeypatch):
    monkeypatch.setattr(bounds, "HOT_PAIRS", 5)
    monkeypatch.setattr(bounds, "HOT_ROWS", 1000)
    index = data(14, 20, 2, 6)
    queries = [(f"{p}/{i}", (p,), v) for p, i, v in index] + [(f"again{n}", (), index[0][2]) for n in range(30)]
    same(run(spark, queries, index, 5, "bounds", per_block=15), brute(queries, index, 5))


def test_blocks_are_bounded_and_keep_partitions_busy():
    assert bounds._block_counts(2000, 2000, 1 << 15, 8) == (7, 1)
    queries, rows = bounds._block_counts(10**7, 10**8, 1 << 15, 2000)
    assert (queries, rows) == (306, 3052)
    assert bounds._block_counts(0, 0, 100, 8) == (1, 1)
