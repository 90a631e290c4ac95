"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. Each pair of reference
points has an inverted list of the vectors that have both among their nearest. Vectors
that meet in a list and share enough reference points are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import attach, bucket_of, components, store, workspace

THRESHOLD = 0.9
#: Nearest reference points that describe a vector, and how many two vectors must share.
NEAREST = 7
SHARED = 2
#: Reference points: this many times the root of the number of vectors, within bounds.
#: The upper bound is that of the sample the index is fitted on.
PIVOT_FACTOR = 8
FEWEST, MOST = 64, 8192
#: Largest cosine between two reference points.
APART = 0.7
#: Vectors compared at a time; longer lists are cut into blocks of this size.
BLOCK = 1024
#: Rows of lists that a task holds at a time, about.
HELD = 20_000

DESCRIBED = "node bigint, members bigint, vector binary, pivots array<int>, keys array<bigint>"
FOUND = "node bigint, n_links bigint, a bigint, b bigint"


def usable() -> F.Column:
    """Not empty, all components finite, not all zero."""
    good = (
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Usable vectors once each, numbered, with how many rows have it and their smallest id."""
    return (
        rows.groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
        .withColumn("node", F.monotonically_increasing_id())
    )


def pivots(once: DataFrame, count: int) -> np.ndarray:
    """Reference points: vectors drawn by a hash of an identifier, of length one.

    A point close to an earlier one is left out: many near-copies among the points would
    give near-copies of them different neighbours.
    """
    wanted = min(MOST, max(FEWEST, int(PIVOT_FACTOR * count**0.5)))
    drawn = once.filter(bucket_of("first") * count < wanted * 1.5 + 32)
    rows = drawn.orderBy(bucket_of("first"), "first").limit(wanted).select("embedding").collect()
    width = max((len(r[0]) for r in rows), default=0)
    points = np.zeros((len(rows), width))
    for point, row in zip(points, rows):
        point[: len(row[0])] = row[0]
    points, taken = _unit(points), np.zeros(len(rows), dtype=bool)
    for i, point in enumerate(points):
        taken[i] = not (points[:i][taken[:i]] @ point >= APART).any()
    return points[taken]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True).clip(min=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(min=1e-300)


def describe(once: DataFrame, points: np.ndarray) -> DataFrame:
    """Unit vector, nearest reference points in order, and list keys of each vector.

    Vectors of another width than the reference points' are filled up with zeros or, if
    longer, described by their first components; they are compared in full later. If all
    vectors lie around one reference point, its own list holds every vector.
    """
    nearest = min(NEAREST, len(points))
    pairs = np.array(list(combinations(range(nearest), 2)) or [(0, 0)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            sizes = [len(v) for v in lists]
            x = np.zeros((len(lists), max([points.shape[1], *sizes])))
            for row, v in zip(x, lists):
                row[: len(v)] = v
            x = _unit(x)
            near = -(x[:, : points.shape[1]] @ points.T)
            some = np.argpartition(near, nearest - 1, axis=1)[:, :nearest]
            order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
            best = np.take_along_axis(some, order, axis=1)
            low = np.minimum(best[:, pairs[:, 0]], best[:, pairs[:, 1]])
            high = np.maximum(best[:, pairs[:, 0]], best[:, pairs[:, 1]])
            keys = (low.astype(np.int64) << 32) | high
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("members"),
                    pa.array([row[:n].tobytes() for row, n in zip(x, sizes)], pa.binary()),
                    pa.array(list(best.astype(np.int32)), pa.list_(pa.int32())),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                names=["node", "members", "vector", "pivots", "keys"],
            )

    return once.select("node", "members", "embedding").mapInArrow(run, DESCRIBED)


def _shared_before(rows: np.ndarray, cols: np.ndarray, first: int, second: int):
    """Reference points that pairs share, and how many of those come before the list's own.

    A pair is compared in the list of the two smallest reference points it shares.
    """
    seen = np.unique(np.concatenate([rows.ravel(), cols.ravel()]))
    marks = []
    for side in (rows, cols):
        mark = np.zeros((len(side), len(seen)), dtype=np.float32)
        mark[np.arange(len(side))[:, None], np.searchsorted(seen, side)] = 1
        marks.append(mark)
    before = (seen < second) & (seen != first)
    return marks[0] @ marks[1].T, marks[0][:, before] @ marks[1][:, before].T


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and how many components each has."""
    sizes = np.array([len(v) // 8 for v in values])
    x = np.zeros((len(values), sizes.max()))
    for row, v in zip(x, values):
        row[: len(v) // 8] = np.frombuffer(v)
    return x, sizes


def links_of_block(key: int, points, vectors, a: np.ndarray, b: np.ndarray, threshold: float):
    """Which rows ``a`` and ``b`` of one list are linked, as a matrix, or nothing.

    Rows of other lists that a pair shares do not repeat it: only the list of its two
    smallest shared reference points has it.
    """
    shared, before = _shared_before(points[a], points[b], key >> 32, key & 0xFFFFFFFF)
    near = (shared >= min(SHARED, points.shape[1])) & (before == 0)
    near &= a[:, None] != b[None, :]
    if not near.any():
        return None
    x, sizes = _matrix([vectors[i] for i in np.concatenate([a, b])])
    n = len(a)
    near &= (x[:n] @ x[n:].T >= threshold) & (sizes[:n, None] == sizes[None, n:])
    return near if near.any() else None


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that keep together what ``near`` does; fewer than rows and columns."""
    rows, cols = np.ones(near.shape[0], dtype=bool), np.ones(near.shape[1], dtype=bool)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        queue, rows[start] = [start] if rows[start] else [], False
        while queue:
            row = queue.pop()
            for col in np.flatnonzero(near[row] & cols).tolist():
                cols[col] = False
                out.append((row, col))
                for other in np.flatnonzero(near[:, col] & rows).tolist():
                    rows[other] = False
                    out.append((other, col))
                    queue.append(other)
    return out


def compare(rows: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links of many lists or blocks of them.

    A row has either how many rows a vector is newly linked with, or a link; there are
    enough links to keep the components, not all of them.
    """
    rows = rows.sort_values(["key", "left", "right"], ignore_index=True)
    keys, left, right = (rows[c].to_numpy() for c in ("key", "left", "right"))
    own, nodes, members = (rows[c].to_numpy() for c in ("own", "node", "members"))
    points, vectors = np.stack(rows["pivots"].to_numpy()), rows["vector"].to_numpy()
    new = (keys[1:] != keys[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    ends: list[tuple[int, int]] = []
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start < 2:
            continue
        at = np.arange(start, stop)
        same = left[start] == right[start]
        a = at if same else at[own[at] == left[start]]
        b = at if same else at[own[at] == right[start]]
        if not len(a) or not len(b):
            continue
        near = links_of_block(int(keys[start]), points, vectors, a, b, threshold)
        if near is None:
            continue
        counts.append((nodes[a], near @ members[b]))
        if not same:
            counts.append((nodes[b], near.T @ members[a]))
        ends += [(nodes[a[i]], nodes[b[j]]) for i, j in forest(near)]
    n = np.concatenate([c[0] for c in counts] or [np.zeros(0, np.int64)])
    size = np.concatenate([c[1] for c in counts] or [np.zeros(0, np.int64)])
    some = pd.DataFrame({"node": n[size > 0], "n_links": size[size > 0]}, dtype="Int64")
    links = pd.DataFrame(ends, columns=["a", "b"], dtype="Int64")
    return pd.concat([some, links]).reindex(columns=["node", "n_links", "a", "b"])


def list_blocks(described: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of blocks of every list that has more than one vector, as ``key``, ``node``, ``own``, ``left``, ``right``."""
    entries = described.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    total = described.agg(F.sum(F.size("keys"))).first()[0] or 0
    met = attach(entries, sizes.filter("n > 1"), "key", "n", total)
    blocks = F.ceil(F.col("n") / block).cast("int")
    return (
        met.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            "node",
            "own",
            F.least("own", "mate").alias("left"),
            F.greatest("own", "mate").alias("right"),
        )
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, held: int = HELD
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Links have a cosine of at least ``threshold`` in double precision; the index finds most
    of them and none below. ``n_links`` counts the other rows linked directly, rows with the same
    vector included. ``component_id`` is the smallest ``vec_id`` that links reach. A vector
    that is null, empty, zero, or has a null or non-finite component, and a row without
    ``vec_id``, links with nothing; nor do vectors of different width. Repeated rows
    are linked with each other. An empty table gives no rows. Needs ``vec_id`` and
    ``embedding``; other columns are not looked at. Computes the links when called.
    """
    folder = workspace(vectors.sparkSession)
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = every.filter(usable())
    once = store(distinct_vectors(rows), folder, "distinct")
    count, total = once.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    alone = every.filter(~usable()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if not count:
        return alone.withColumn("kept", F.lit(True))
    described = store(describe(once, pivots(once, count)), folder, "described")
    pairs = store(list_blocks(described, block), folder, "lists")
    buckets = -(-pairs.count() // held) or 1
    found = (
        pairs.join(described.select("node", "members", "vector", "pivots"), "node")
        .withColumn("bucket", F.pmod(F.xxhash64("key", "left", "right"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(lambda some: compare(some, threshold), FOUND)
    )
    found = store(found, folder, "found")
    roots = components(found.filter("a IS NOT NULL").select("a", "b"), folder)
    links = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = (
        once.select("node", "first", "members")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(links, "node", "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("members") - 1)
    )
    named = store(named, folder, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = attach(named, store(least, folder, "least"), "root", "n", count)
    named = named.select("node", "n_links", "component_id", "members")
    of_vector = once.select("embedding", "node").join(named, "node")
    linked = attach(rows, store(of_vector, folder, "classes"), "embedding", "members", total)
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
