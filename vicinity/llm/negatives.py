"""Hard negatives: clusters of anchors share one list of candidates each, sorted by an angular
upper bound of their scores, and every anchor walks its list until nothing can follow."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bucket_of, store, workspace

#: Anchors of a cluster on average, clusters at most, and anchors that walk in one task.
CLUSTER_ANCHORS = 256
MOST_CLUSTERS = 64
BLOCK_ANCHORS = 1024
#: Anchors and candidates that the driver looks at to place clusters and first cuts.
SAMPLE = 4096
#: Bytes of the candidates in one task, as doubles, and candidates scored in one step.
BLOCK_BYTES = 16 << 20
STEP = 512
#: Share of the candidates in the first part of each list, and candidates in it at least.
HEAD_SHARE = 0.02
HEAD_LEAST = 2048

ROUNDS = 10
#: Bounds are rounded up by so much, so that no rounding ends a walk too early.
SLACK, LITTLE = 1 + 1e-9, 1e-6
LOWEST, HIGHEST = -(1 << 62), 1 << 62

HITS = "anchor_id bigint, request int, vec_id bigint, score bigint"
MEMBER = "anchor_id bigint, label bigint, x array<bigint>, cluster int, angle double, norm double"


def matrix(column) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; a vector goes on with zeros after its end."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(wide, 1) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in b], object).reshape(b.shape)
    out = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ whole.T
    if max(abs(out.max()), abs(out.min())) >= HIGHEST:
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


@dataclass(frozen=True)
class Clusters:
    """Centres, the widest angle of an anchor from each, and the part of the lists looked at."""

    centres: np.ndarray
    widest: np.ndarray
    head: np.ndarray
    #: Bounds from ``least`` up to below ``below`` are listed.
    least: np.ndarray | None = None
    below: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        wide = min(x.shape[1], self.centres.shape[1])
        length = np.linalg.norm(x, axis=1)
        cosine = x[:, :wide] @ self.centres[:, :wide].T / np.where(length > 0, length, 1)[:, None]
        return np.arccos(np.clip(cosine, -1, 1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each vector and cluster: no anchor of length one in it has a larger product."""
        turned = np.cos(np.maximum(self.angles(x) - self.widest, 0))
        return np.linalg.norm(x, axis=1)[:, None] * turned


def _place(vectors: np.ndarray, count: int) -> np.ndarray:
    """Centres on the unit sphere, by spherical k-means from spread-out first ones."""
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    centres = unit[:1]
    near = unit @ centres[0]
    for _ in range(1, min(count, len(unit))):
        centres = np.vstack([centres, unit[np.argmin(near)]])
        near = np.maximum(near, unit @ centres[-1])
    for _ in range(ROUNDS):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def _sampled(rows: DataFrame, count: int) -> np.ndarray:
    """Vectors of about ``SAMPLE`` rows, drawn by a hash of the identifier."""
    drawn = rows.filter(bucket_of("vec_id", seed=12) * count < SAMPLE).select("x").toArrow()
    return matrix(drawn["x"]) if len(drawn) else np.zeros((0, 1))


def _assign(clusters: Clusters):
    def run(batches):
        for batch in batches:
            x = matrix(batch["x"])
            angles = clusters.angles(x)
            own = angles.argmin(axis=1)
            norm = np.linalg.norm(x, axis=1)
            # A vector of zeros has no direction and every score of it is zero.
            angle = np.where(norm > 0, angles[np.arange(len(own)), own], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], batch["x"], pa.array(own, pa.int32()), pa.array(angle), pa.array(norm)],
                names=["anchor_id", "label", "x", "cluster", "angle", "norm"],
            )

    return run


def _listed(clusters: Clusters):
    """Each candidate once for every cluster in whose part of the list it stands."""

    def run(batches):
        for batch in batches:
            bounds = clusters.bounds(matrix(batch["x"]))
            row, cluster = np.nonzero((bounds >= clusters.least) & (bounds < clusters.below))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(bounds[row, cluster]), *taken.columns],
                names=["cluster", "bound", *taken.schema.names],
            )

    return run


def best(requests: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int):
    """The first ``most`` of each request, larger scores first, then smaller identifiers."""
    order = np.lexsort((ids, -scores, requests))
    requests, scores, ids = requests[order], scores[order], ids[order]
    new = np.r_[True, requests[1:] != requests[:-1]] if len(requests) else np.zeros(0, bool)
    rank = np.arange(len(requests)) - np.maximum.accumulate(np.where(new, np.arange(len(requests)), 0))
    kept = rank < most
    return requests[kept], scores[kept], ids[kept], rank[kept]


def walk(most: int, same: bool):
    """Task of one block of anchors and one block of their list.

    A step scores the next candidates for the anchors that are still on their way. An anchor
    stops as soon as its length times the bound is below what each of its requests needs.
    """

    def run(_key, listed: pa.Table, members: pa.Table) -> pa.Table:
        order = np.argsort(-listed["bound"].to_numpy(), kind="stable")
        bound, ids = listed["bound"].to_numpy()[order], listed["vec_id"].to_numpy()[order]
        labels, x = listed["label"].to_numpy()[order], matrix(listed["x"])[order]
        anchors, own, a = members["anchor_id"].to_numpy(), members["label"].to_numpy(), matrix(members["x"])
        norm = np.linalg.norm(a, axis=1)
        asked = members["asked"].to_pylist()
        wide = max((len(r) for r in asked), default=0)
        number = np.zeros((len(asked), wide), np.int64)
        low, high = np.full(number.shape, HIGHEST), np.full(number.shape, LOWEST)
        for row, requests in enumerate(asked):
            for column, r in enumerate(requests):
                number[row, column], low[row, column], high[row, column] = r["request"], r["least"], r["high"]
        found = np.zeros((3, 0), np.int64)
        for start in range(0, len(bound), STEP):
            live = np.flatnonzero(norm * bound[start] * SLACK + LITTLE >= low.min(axis=1, initial=HIGHEST))
            if not len(live):
                break
            part = slice(start, start + STEP)
            scores = products(a[live], x[part])
            fits = (own[live, None] == labels[None, part]) == same
            fits &= anchors[live, None] != ids[None, part]
            new = [found]
            for column in range(wide):
                hit = fits & (scores >= low[live, column, None]) & (scores <= high[live, column, None])
                row, at = np.nonzero(hit)
                new.append(np.stack([live[row] * wide + column, scores[row, at], ids[part][at]]))
            request, score, ident, rank = best(*np.concatenate(new, axis=1), most)
            found = np.stack([request, score, ident])
            last = rank == most - 1
            low.reshape(-1)[request[last]] = score[last]
        request, score, ident = found
        return pa.table({
            "anchor_id": pa.array(anchors[request // max(wide, 1)], pa.int64()),
            "request": pa.array(number.reshape(-1)[request], pa.int32()),
            "vec_id": pa.array(ident, pa.int64()),
            "score": pa.array(score, pa.int64()),
        })

    return run


def _walked(rows, members, clusters: Clusters, sizes: dict[int, int], share, most, same) -> DataFrame:
    """Hits of every block of anchors with every block of its cluster's part of the list."""
    count, wide = sizes["rows"], sizes["wide"]
    block = max(BLOCK_BYTES // (8 * max(wide, 1)), STEP)
    many = range(len(clusters.centres))
    anchor_blocks = [math.ceil(max(sizes.get(c, 0), 1) / BLOCK_ANCHORS) for c in many]
    list_blocks = [math.ceil(max(share[c] * count, 1) / block) for c in many]

    def of(values) -> Column:
        return F.get(F.lit(np.array(values, np.int64)), F.col("cluster"))

    def every(values) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), of(values) - 1))

    listed = rows.mapInArrow(_listed(clusters), f"cluster int, bound double, {_ddl(rows)}")
    listed = listed.withColumn("list_block", F.pmod(F.xxhash64("vec_id"), of(list_blocks))).withColumn(
        "anchor_block", every(anchor_blocks)
    )
    walking = members.withColumn("anchor_block", F.pmod(F.xxhash64("anchor_id"), of(anchor_blocks))).withColumn(
        "list_block", every(list_blocks)
    )
    keys = ("cluster", "anchor_block", "list_block")
    return listed.groupBy(*keys).cogroup(walking.groupBy(*keys)).applyInArrow(walk(most, same), HITS)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _first(hits: DataFrame, most: int) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY anchor_id, request ORDER BY score DESC, vec_id)")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most)


def search(rows, anchors, requests, clusters: Clusters, sizes, most: int, same: bool, folder: str) -> DataFrame:
    """The best candidates of every request: ``anchor_id, request, vec_id, score, rank``.

    A request (``anchor_id, request, low, high``) wants scores from ``low`` to ``high``, of
    candidates with the anchor's label (``same``) or another. The heads of the lists come
    first and give each request a score to beat; of the rest only what can reach that of
    some anchor of the cluster is moved at all.
    """
    name = "same" if same else "other"

    def members(asked: DataFrame) -> DataFrame:
        grouped = asked.groupBy("anchor_id").agg(
            F.collect_list(F.struct("request", "least", "high")).alias("asked"), F.min("least").alias("needs")
        )
        return anchors.select("anchor_id", "label", "x", "cluster", "norm").join(grouped, "anchor_id")

    asked = requests.select("anchor_id", "request", F.col("low").alias("least"), "high")
    many = len(clusters.centres)
    head = replace(clusters, least=clusters.head, below=np.full(many, np.inf))
    share = [HEAD_SHARE + HEAD_LEAST / max(sizes["rows"], 1)] * many
    hits = _walked(rows, members(asked), head, sizes, share, most, same)
    hits = store(_first(hits, most), folder, f"{name}_head")
    secured = hits.filter(F.col("rank") == most).select("anchor_id", "request", F.col("score").alias("kth"))
    asked = asked.join(secured, ["anchor_id", "request"], "left").withColumn("least", F.greatest("least", "kth"))
    # Zero anchors score zero with everything; for others the bound times the length decides.
    needed = F.when(F.col("norm") > 0, (F.col("needs") - 2 * LITTLE) / F.col("norm") / SLACK).when(
        F.col("needs") <= 0, float("-inf")
    )
    on = store(members(asked).withColumn("needed", needed).filter("needed IS NOT NULL"), folder, f"{name}_asked")
    cut = {r.cluster: r.needed for r in on.groupBy("cluster").agg(F.min("needed").alias("needed")).collect()}
    least = np.array([cut.get(c, np.inf) for c in range(many)])
    least -= np.abs(np.where(np.isfinite(least), least, 0)) * 1e-9
    rest = replace(clusters, least=least, below=clusters.head)
    more = _walked(rows, on, rest, sizes, [1.0] * many, most, same)
    return _first(hits.drop("rank").unionByName(more), most)


def prepared(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, x``: rows that take part, components as whole numbers."""
    each = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), each.alias("x"))


def _narrowed(rows: DataFrame, largest: int) -> DataFrame:
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"
    return rows.withColumn("x", F.col("x").cast(f"array<{kind}>"))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of the components times ``scale``, rounded down. Of each row
    that ``anchors`` holds for, the ``positives`` best other rows of its label are taken, and
    for each of them the ``negatives`` best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. Ties go to the smaller ``vec_id``. Rows with a null
    ``vec_id``, label, vector or component, or one that is not finite, take no part. Of rows
    that share a ``vec_id`` the one with the smallest label, then vector, takes part. Vectors
    of different length are compared as if zeros followed; an empty one scores 0 with all.
    A score beyond a long raises ``OverflowError``. Other columns are not looked at. All
    results are exact: no candidate is left out that could rank. Places the clusters and
    searches the heads of the lists when called.
    """
    folder = workspace(vectors.sparkSession)
    wanted = prepared(vectors, scale)
    rows = store(wanted, folder, "rows")
    facts = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("x")).alias("wide"),
        F.max(F.coalesce(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))), F.lit(0))).alias("largest"),
    ).first()
    if facts.ids < facts.rows:
        one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*")
        rows = store(one, folder, "one")
    rows = _narrowed(rows, facts.largest or 0)
    chosen = rows.filter(anchors)
    count = chosen.count()
    clusters = Clusters(
        _place(_sampled(chosen, count), min(max(count // CLUSTER_ANCHORS, 1), MOST_CLUSTERS)), np.zeros(1), np.zeros(1)
    )
    members = store(
        chosen.mapInArrow(_assign(clusters), MEMBER.replace("array<bigint>", dict(rows.dtypes)["x"])), folder, "anchors"
    )
    sizes = {"rows": facts.ids, "wide": facts.wide or 0}
    widest = np.zeros(len(clusters.centres))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect():
        widest[r.cluster], sizes[r.cluster] = r.angle + 1e-7, r.n
    clusters = replace(clusters, widest=widest)
    seen = clusters.bounds(_sampled(rows, facts.ids))
    share = min(HEAD_SHARE + HEAD_LEAST / max(facts.ids, 1), 1.0)
    clusters = replace(clusters, head=np.quantile(seen, 1 - share, axis=0) if len(seen) else widest - np.inf)

    whole = members.select("anchor_id", F.lit(0).alias("request"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    near = store(search(rows, members, whole, clusters, sizes, positives, True, folder), folder, "positives")
    near = near.select(
        "anchor_id", F.col("rank").alias("request"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )

    # In decimals, as a percentage of a large score passes a long on its way.
    part = "cast(positive_score AS decimal(20, 0)) * {} * 0.01BD"
    bands = near.selectExpr(
        "anchor_id", "request", f"cast(ceil({part.format(int(low))}) AS bigint) AS low",
        f"cast(floor({part.format(int(high))}) AS bigint) AS high",
    ).filter("low <= high")
    far = search(rows, members, bands, clusters, sizes, negatives, False, folder)
    return far.join(near, ["anchor_id", "request"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
