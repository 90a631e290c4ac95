"""Exact cosine top-k of many query vectors against a chunk index.

Three plans give the same rows:

* ``broadcast``: a bounded set of queries is sent to every task, the index is scanned
  once where it lies, each partition keeps its best k per query, and only those travel.
* ``cells``: for more queries than that. Index rows are grouped around pivot vectors.
  Each query first looks into its nearest cells, which gives a score its k-th best hit
  is sure to reach; then it visits every cell that, by the triangle inequality on
  angles, may still hold a better one. Nothing that could rank is skipped. Cells are packed and
  cut into blocks of bounded size on both sides, so a crowded cell becomes many tasks and a
  query's vector moves once for each block, not for each cell.
* ``bounds`` (in ``bounds.py``): blocks of vectors compressed to a byte a component meet, with
  bounds of what that costs; only pairs that the bounds cannot rule out are scored in full.

All work on matrix products of one block of queries with one block of rows and give out
few pairs per query and block; the table of all pairs is never materialised. Order everywhere:
``score`` descending, then ``path``, then ``chunk_index``. Scores are taken to 12 decimals:
what lies below is noise of the order of summation, and must not decide a tie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.lineage import cut_lineage
from vicinity.operators.embedding import sliced

#: Largest limit that Spark's partial window limit takes by default.
PARTIAL_LIMIT = 1000
SALTS = 64
BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
#: Vectors in doubles of one side of a block. A task holds two such sides, whatever the tables.
BLOCK_BYTES = 16 << 20
SCORE_CELLS = 1 << 20
#: Rows of one matrix product. Few rows leave room for many queries, without which a product is slow.
TILE_ROWS = 1024
#: The k-th best of every so many rows is a floor for the k-th best of all.
SAMPLED = 8
MIN_BLOCK_ROWS = 256
#: Visits that leave a task at once.
VISITS = 4096
BLOCKS_PER_CORE = 8
CELL_ROWS = 2048
MAX_PIVOTS = 1024
PROBED_CELLS = 2
SLACK = 1e-9
SCORE_DECIMALS = 12

_EXCLUDES = ("exclude_path", "exclude_paths")


# --- kernel: runs inside a task on one block of queries and one block of rows ---------


def _matrix(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; zero rows become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return np.zeros((0, 0))
    values = flat.reshape(rows, -1)
    length = np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return values / length


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(
        pc.sort_indices(rows, sort_keys=[("path", "ascending"), ("chunk_index", "ascending")])
    )


def _excluded_cells(queries: pa.Table, paths: pa.Array):
    """(query, row) positions that must not match. ``paths`` is sorted."""
    codes = paths.dictionary_encode()
    first = {p: i for i, p in enumerate(codes.dictionary.to_pylist())}
    code_of_row = codes.indices.to_numpy()
    starts = np.searchsorted(code_of_row, np.arange(len(first) + 1))
    lists = []
    if "exclude_path" in queries.column_names:
        lists.append([[p] for p in queries.column("exclude_path").to_pylist()])
    if "exclude_paths" in queries.column_names:
        lists.append([p or [] for p in queries.column("exclude_paths").to_pylist()])
    spans: list[list[tuple[int, int]]] = [[] for _ in range(queries.num_rows)]
    for column in lists:
        for row, wanted in enumerate(column):
            for path in wanted:
                code = first.get(path)
                if code is not None:
                    spans[row].append((starts[code], starts[code + 1]))
    return spans


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each line, or minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    at = scores.shape[1] - k
    return np.partition(scores, at, axis=1)[:, at]


def _product(queries: np.ndarray, rows: np.ndarray, blank: bool) -> np.ndarray:
    """Scores of all pairs; ``blank`` tells that either side has NaN."""
    scores = queries @ rows.T
    if blank:
        # A comparison with NaN is false, but a partition would put it last.
        np.copyto(scores, -np.inf, where=np.isnan(scores))
    return scores


def _reaching(scores: np.ndarray, floor: np.ndarray):
    """Positions of the scores that reach the floor of their line.

    Most lines of a tile have none, which their largest score tells. In the others eight scores are
    passed over at a time.
    """
    lines = np.flatnonzero(scores.max(axis=1) >= floor)
    reach = (scores[lines] >= floor[lines, None]).ravel()
    whole = reach.size // 8 * 8
    at = (np.flatnonzero(reach[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[reach[at]], whole + np.flatnonzero(reach[whole:])])
    line, column = np.divmod(at, scores.shape[1])
    return lines[line], column


def _near_kth(queries: np.ndarray, rows: np.ndarray, sampled: np.ndarray, cuts: np.ndarray,
              floor: np.ndarray, k: int, slack: float, blank: bool):
    """Positions of the scores that reach the floor and, up to the slack, the k-th best of their line.

    ``cuts`` has lines with a first and a last row between which nothing counts.
    """
    scores = _product(queries, sampled, blank)
    for line, a, b in cuts:
        scores[line, -(-a // SAMPLED) : -(-b // SAMPLED)] = -np.inf
    floor = np.maximum(floor, _kth(scores, k)) - slack
    found = []
    for first in range(0, len(rows), TILE_ROWS):
        scores = _product(queries, rows[first : first + TILE_ROWS], blank)
        for line, a, b in cuts[(cuts[:, 1] < first + TILE_ROWS) & (cuts[:, 2] > first)]:
            scores[line, max(a - first, 0) : b - first] = -np.inf
        qi, ri = _reaching(scores, floor)
        found.append((qi, ri + first, scores[qi, ri]))
    qi, ri, value = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((-value, qi))
    qi, ri, value = qi[order], ri[order], value[order]
    first = np.searchsorted(qi, qi)
    last = np.minimum(first + k, np.searchsorted(qi, qi, "right")) - 1
    keep = value >= value[last] - slack
    return qi[keep], ri[keep]


def _top_k(queries: pa.Table, rows: pa.Table, k: int, min_score: float):
    """(query position, row position, score) of the best k rows of each query.

    Candidates come from a matrix product in single precision, whose last bits depend on the
    block's shape. All rows that its error may hide near the k-th value are then scored again in
    double precision, one pair at a time, so equal vectors get equal scores in every block and
    ties fall the same way everywhere. A query's ``reach`` is a score that k rows elsewhere have.
    """
    left, right = _matrix(queries.column("embedding")), _matrix(rows.column("embedding"))
    if not left.size or not right.size:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    spans = _excluded_cells(queries, rows.column("path").combine_chunks())
    least = np.full(len(left), min_score)
    if "reach" in queries.column_names:
        reach = queries.column("reach").to_numpy().astype(float)
        least = np.maximum(least, np.nan_to_num(reach, nan=min_score))
    # Products of unit vectors of this width are right to far less than this.
    slack = SLACK + 4 * (right.shape[1] + 4) * float(np.finfo(np.float32).eps)
    short = right.astype(np.float32)
    sampled = np.ascontiguousarray(short[::SAMPLED])
    blank = bool(np.isnan(left).any() or np.isnan(right).any())
    step = max(1, SCORE_CELLS // max(min(len(right), TILE_ROWS), len(sampled)))
    found = []
    for begin in range(0, len(left), step):
        part = left[begin : begin + step]
        cuts = [(line, a, b) for line, cut in enumerate(spans[begin : begin + step]) for a, b in cut]
        qi, ri = _near_kth(
            part.astype(np.float32), short, sampled, np.array(cuts, dtype=np.int64).reshape(-1, 3),
            least[begin : begin + step], k, slack, blank,
        )
        exact = np.empty(len(qi))
        width = max(1, SCORE_CELLS // right.shape[1])
        for a in range(0, len(qi), width):
            b = a + width
            exact[a:b] = np.einsum("ij,ij->i", part[qi[a:b]], right[ri[a:b]])
        exact = np.round(exact, SCORE_DECIMALS) + 0.0
        keep = exact >= least[begin : begin + step][qi]
        qi, ri, exact = qi[keep], ri[keep], exact[keep]
        order = np.lexsort((ri, -exact, qi))
        qi, ri, exact = qi[order], ri[order], exact[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < k
        found.append((qi[keep] + begin, ri[keep], exact[keep]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _hits(queries: pa.Table, rows: pa.Table, ids: list[str], k: int, min_score: float):
    rows = _in_order(rows)
    qi, ri, score = _top_k(queries, rows, k, min_score)
    qi, ri = pa.array(qi, pa.int64()), pa.array(ri, pa.int64())
    return pa.table(
        [queries.column(c).take(qi) for c in ids]
        + [rows.column("path").take(ri), rows.column("chunk_index").take(ri), pa.array(score)],
        names=[*ids, "path", "chunk_index", "score"],
    )


# --- helpers ---------------------------------------------------------------------------


def _hit_schema(queries: DataFrame, ids: list[str]) -> T.StructType:
    by_name = {f.name: f for f in queries.schema.fields}
    return T.StructType(
        [by_name[c] for c in ids]
        + [
            T.StructField("path", T.StringType()),
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def top_hits(hits: DataFrame, ids: list[str], k: int) -> DataFrame:
    """Best k hits per query with their ``rank``, cut before the shuffle and after it."""
    order = Window.partitionBy(*ids).orderBy(F.desc("score"), "path", "chunk_index")
    hits = first_of_salted(hits, ids, [F.desc("score"), "path", "chunk_index"], k)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_of_salted(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """Rows that can be among the first ``limit`` of their key, if the limit is high.

    Spark cuts a window's rows before the shuffle up to a threshold only. Beyond it the
    rows of a key are first ranked in salted parts, of which each keeps its first, so no task gets
    more than that many rows of a key from each part.
    """
    if limit <= PARTIAL_LIMIT:
        return rows
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("path", "chunk_index"), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= limit)
    return kept.drop("_salt", "_part")


def best_by_block(
    queries: DataFrame, rows: DataFrame, key: list[str], ids: list[str], k: int,
    min_score: float = 0.0,
) -> DataFrame:
    """Top-k of each query inside each block; both sides carry the block ``key``."""
    schema = _hit_schema(queries, ids)
    more = [c for c in (*_EXCLUDES, "reach") if c in queries.columns and c not in ids]
    names = list(dict.fromkeys([*key, *ids, *more, "embedding"]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _hits(left, right, ids, k, min_score)

    held = list(dict.fromkeys([*key, "path", "chunk_index", "embedding"]))
    # Renaming to the same names keeps the sides apart when both come from one table.
    left = queries.select(*names).groupBy(*key)
    right = rows.select(*[F.col(c).alias(c) for c in held]).groupBy(*key)
    return left.cogroup(right).applyInArrow(run, schema)


def rows_in_reach(index: DataFrame, k: int, excluded: int) -> DataFrame:
    """Index rows that can be among some query's best k.

    Rows with one and the same vector tie for every query and are ordered by path, so
    only the first few can ever rank: k of them, plus the at most k per path that a
    query with ``excluded`` paths would pass over. A vector held by a third of all rows
    shrinks to a handful, and the windows cut it down before they shuffle. The hash in
    front of the vector makes comparing rows cheap.
    """
    same = ("_hash", "embedding")
    chunk = Window.partitionBy(*same, "path").orderBy("chunk_index")
    copy = Window.partitionBy(*same).orderBy("path", "chunk_index")
    most = k * (1 + excluded)
    rows = index.withColumn("_hash", F.xxhash64("embedding"))
    rows = first_of_salted(rows, [*same, "path"], ["chunk_index"], k)
    rows = rows.withColumn("_nth", F.row_number().over(chunk)).filter(F.col("_nth") <= k)
    rows = first_of_salted(rows.drop("_nth"), [*same], ["path", "chunk_index"], most)
    rows = rows.withColumn("_nth", F.row_number().over(copy)).filter(F.col("_nth") <= most)
    return rows.drop("_nth", "_hash")


def _query_side(queries: DataFrame) -> tuple[DataFrame, list[str]]:
    ids = [c for c in queries.columns if c not in ("embedding", *_EXCLUDES)]
    return queries.filter(F.size("embedding") > 0), ids


# --- plan 1: bounded queries, one scan of the index --------------------------------------


def _broadcast_plan(
    fetched: pa.Table, queries: DataFrame, ids: list[str], index: DataFrame, k: int,
    min_score: float,
) -> DataFrame:
    schema = _hit_schema(queries, ids)
    shared = index.sparkSession.sparkContext.broadcast(fetched)
    block_rows = max(1024, SCORE_CELLS // max(1, fetched.num_rows))

    def run(batches):
        asked = shared.value
        held: list[pa.RecordBatch] = []
        best: list[pa.Table] = []

        def flush():
            if held:
                best.append(_hits(asked, pa.Table.from_batches(held), ids, k, min_score))
                held.clear()
            if len(best) > 1 and sum(t.num_rows for t in best) > 4 * k * asked.num_rows:
                best[:] = [_prune(pa.concat_tables(best), ids, k)]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= block_rows:
                flush()
        flush()
        if best:
            yield from _prune(pa.concat_tables(best), ids, k).to_batches()

    partial = index.mapInArrow(run, schema)
    return top_hits(partial, ids, k)


def _prune(hits: pa.Table, ids: list[str], k: int) -> pa.Table:
    """Best k per query of a table of hits."""
    order = [(c, "ascending") for c in ids]
    order += [("score", "descending"), ("path", "ascending"), ("chunk_index", "ascending")]
    hits = hits.combine_chunks().sort_by(order)
    if not hits.num_rows:
        return hits
    same = np.ones(hits.num_rows - 1, bool)
    for column in ids:
        values = hits.column(column).combine_chunks()
        codes = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        same &= codes[1:] == codes[:-1]
    new = np.concatenate([[True], ~same])
    starts = np.flatnonzero(new)
    place = np.arange(hits.num_rows) - starts[np.cumsum(new) - 1]
    return hits.filter(pa.array(place < k))


# --- plan 2: cells ------------------------------------------------------------------------


def _pivots(index: DataFrame, rows: int, cell_rows: int) -> np.ndarray:
    """A bounded, evenly spread choice of index vectors. Any choice gives exact results.

    Smaller cells can be skipped more often, but each visit moves a query's vector; about
    two thousand rows are worth the move.
    """
    wanted = min(MAX_PIVOTS, max(1, rows // cell_rows))
    spread = F.xxhash64("path", "chunk_index")
    stride = max(1, rows // (8 * wanted))
    chosen = (
        index.filter(F.pmod(spread, F.lit(stride)) == 0)
        .orderBy(spread)
        .limit(wanted)
        .select("embedding")
        .toArrow()
    )
    units = _matrix(chosen.column("embedding"))
    units = units[~np.isnan(units).any(axis=1)] if units.size else units
    return np.unique(units, axis=0)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _with_cell(index: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the angle to it; drops zero vectors, which never match."""
    schema = T.StructType(
        index.schema.fields
        + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in sliced(batches, max(1, SCORE_CELLS // len(shared.value))):
            units = _matrix(batch.column("embedding"))
            usable = ~np.isnan(units).any(axis=1)
            batch, units = batch.filter(pa.array(usable)), units[usable]
            angles = _angles(units, shared.value)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(cell, pa.int32()),
                    pa.array(angles[np.arange(len(cell)), cell]),
                ],
                names=[*batch.schema.names, "cell", "angle"],
            )

    return index.mapInArrow(run, schema)


def _packed(cells: np.ndarray, sizes: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """A group number for each cell: neighbours share one while their rows fit into a block.

    A visit moves a query's vector, so a query visits groups, however small the cells are that
    tell which ones it needs. A cell larger than a block has a group of its own.
    """
    left, near = set(range(len(cells))), pivots[cells] @ pivots[cells].T
    groups, at, number, held = np.zeros(len(cells), np.int32), 0, 0, 0
    while left:
        left.remove(at)
        if held and held + sizes[at] > most:
            number, held = number + 1, 0
        groups[at], held = number, held + sizes[at]
        near[:, at] = -np.inf
        at = int(near[at].argmax())
    return groups


def _with_visits(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray,
                 groups: np.ndarray, phase: str, min_score: float) -> DataFrame:
    """One row per query and group of cells to visit, as ``cell``.

    ``probe``: groups of the nearest cells. ``rest``: all other groups with a cell whose best
    possible score reaches ``reach``, the score already secured by the probe.
    """
    kept = queries.schema.fields
    schema = T.StructType(kept + [T.StructField("cell", T.IntegerType())])
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells, radii, groups))

    def run(batches):
        centers, numbers, widest, group = shared.value
        count = int(group.max()) + 1

        def grouped(line, cell):
            out = np.zeros((len(units), count), bool)
            out[line, group[cell]] = True
            return out

        for batch in sliced(batches, max(1, SCORE_CELLS // len(numbers))):
            units = _matrix(batch.column("embedding"))
            usable = ~np.isnan(units).any(axis=1)
            batch, units = batch.filter(pa.array(usable)), units[usable]
            nearest = np.maximum(_angles(units, centers[numbers]) - widest, 0.0)
            best = np.cos(nearest)
            near = np.argsort(nearest, axis=1, kind="stable")[:, :PROBED_CELLS]
            line, place = np.nonzero(np.take_along_axis(best, near, axis=1) >= min_score - SLACK)
            visit = grouped(line, near[line, place])
            if phase == "rest":
                known = batch.column("reach").to_numpy(zero_copy_only=False).astype(float)
                reach = np.maximum(min_score, np.nan_to_num(known, nan=min_score))
                visit = grouped(*np.nonzero(best >= (reach - SLACK)[:, None])) & ~visit
            qi, gi = np.nonzero(visit)
            # A query can have many visits, and each carries its vector.
            for a in range(0, len(qi), VISITS):
                take = pa.array(qi[a : a + VISITS], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).take(take) for f in kept]
                    + [pa.array(gi[a : a + VISITS], pa.int32())],
                    names=[*(f.name for f in kept), "cell"],
                )

    return queries.mapInArrow(run, schema)


def _blocks(counts, per_block: int) -> dict[int, int]:
    return {row["cell"]: math.ceil(row["n"] / per_block) for row in counts}


def _block_rows(queries: int, rows: int, dim: int, cores: int) -> int:
    """Most rows and queries of a block: as many on both sides, which moves the least, few enough
    for memory, and with enough blocks for all cores if everything meets everything."""
    busy = math.isqrt(queries * rows // (BLOCKS_PER_CORE * cores))
    return max(MIN_BLOCK_ROWS, min(busy, BLOCK_BYTES // (8 * dim)))


def _lookup(table: dict[int, int], cell: Column) -> Column:
    """Value per cell number, as a literal array; there are at most ``MAX_PIVOTS`` cells."""
    size = max(table, default=-1) + 1
    values = F.array(*[F.lit(table.get(i, 0)) for i in range(size)]) if size else F.array(F.lit(0))
    return F.get(values, cell)


def _visit(pairs: DataFrame, rows: DataFrame, row_blocks: dict[int, int], ids: list[str],
           k: int, min_score: float, per_block: int) -> DataFrame:
    """Hits of all (query, cell) visits, in blocks of bounded size on both sides."""
    counts = pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()
    query_blocks = _blocks(counts, per_block)

    def own(table, hashed):
        return F.pmod(hashed, F.greatest(_lookup(table, F.col("cell")), F.lit(1)))

    def every(table):
        return F.explode(F.sequence(F.lit(0), _lookup(table, F.col("cell")) - 1))

    asked = pairs.withColumn("query_block", own(query_blocks, F.xxhash64(*ids)).cast("int"))
    asked = asked.withColumn("row_block", every(row_blocks))
    held = rows.filter(_lookup(query_blocks, F.col("cell")) > 0).withColumn(
        "row_block", own(row_blocks, F.xxhash64("path", "chunk_index")).cast("int")
    )
    held = held.withColumn("query_block", every(query_blocks))
    return best_by_block(asked, held, ["cell", "row_block", "query_block"], ids, k, min_score)


def most_excluded(queries: DataFrame) -> int:
    """The most paths that any query passes over."""
    excluded = int("exclude_path" in queries.columns)
    if "exclude_paths" in queries.columns:
        longest = queries.agg(F.max(F.size("exclude_paths"))).first()[0]
        excluded += max(0, longest or 0)
    return excluded


def _cells_plan(queries: DataFrame, ids: list[str], index: DataFrame, k: int,
                min_score: float, per_block: int | None, cell_rows: int) -> DataFrame:
    # Both are read by several of the steps below: computed once, kept reliably. The
    # queries may come out of a model.
    queries = cut_lineage(queries)
    excluded = most_excluded(queries)
    pivots = _pivots(index, index.count(), cell_rows)
    if not len(pivots):
        empty = index.sparkSession.createDataFrame([], _hit_schema(queries, ids))
        return top_hits(empty, ids, k)
    rows = cut_lineage(_with_cell(rows_in_reach(index, k, excluded), pivots))
    stats = rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("radius")
    ).orderBy("cell").collect()
    cells = np.array([s["cell"] for s in stats], dtype=np.int32)
    radii = np.array([s["radius"] for s in stats])
    sizes = np.array([s["n"] for s in stats], dtype=np.int64)
    per_block = per_block or _block_rows(
        queries.count(), int(sizes.sum()), pivots.shape[1], index.sparkSession.sparkContext.defaultParallelism
    )
    groups = _packed(cells, sizes, pivots, per_block)
    in_group = np.bincount(groups, weights=sizes) if len(sizes) else np.zeros(0)
    row_blocks = {g: math.ceil(n / per_block) for g, n in enumerate(in_group)}
    group = _lookup(dict(zip(cells.tolist(), groups.tolist())), F.col("cell"))
    rows = rows.withColumn("cell", group)

    pairs = _with_visits(queries, pivots, cells, radii, groups, "probe", min_score)
    first = cut_lineage(
        top_hits(_visit(pairs, rows, row_blocks, ids, k, min_score, per_block), ids, k)
    )
    secured = first.filter(F.col("rank") == k).select(*ids, F.col("score").alias("reach"))
    rest = _with_visits(
        queries.join(secured, ids, "left"), pivots, cells, radii, groups, "rest", min_score
    )
    more = _visit(rest, rows, row_blocks, ids, k, min_score, per_block)
    return top_hits(first.drop("rank").unionByName(more), ids, k)


# --- entry ----------------------------------------------------------------------------------


def knn_chunks(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    min_score: float = 0.0,
    plan: str = "auto",
    per_block: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Best ``k`` chunks of every query: query columns, ``path, chunk_index, score, rank``.

    ``queries`` holds ``embedding``, one or more columns that identify a query, and
    optionally ``exclude_path`` (one path) or ``exclude_paths`` (an array) whose chunks
    are passed over before the cut. ``score >= min_score`` is inclusive. Vectors need
    not be of unit length.

    ``auto`` broadcasts the queries when a bounded fetch shows that they fit. Otherwise
    ``cell_rows`` is the wanted size of a cell and ``per_block`` the most rows and queries
    that meet in one step; neither changes the result. ``bounds`` moves an eighth of the bytes
    and is the better choice for vectors without clusters, where few cells can be left out.
    """
    queries, ids = _query_side(queries)
    index = index.filter(F.size("embedding") > 0).select("path", "chunk_index", "embedding")
    if plan not in ("auto", "broadcast", "cells", "bounds"):
        raise ValueError(f"unknown plan {plan!r}")
    if plan == "bounds":
        from vicinity.operators.bounds import bounds_plan

        return bounds_plan(queries, ids, index, k, min_score, per_block, cell_rows)
    if plan != "cells":
        fetched = queries.limit(BROADCAST_ROWS + 1).toArrow()
        if fetched.num_rows <= BROADCAST_ROWS and fetched.nbytes <= BROADCAST_BYTES:
            return _broadcast_plan(fetched, queries, ids, index, k, min_score)
        if plan == "broadcast":
            raise ValueError("too many queries to broadcast; use the cells plan")
    return _cells_plan(queries, ids, index, k, min_score, per_block, cell_rows)
