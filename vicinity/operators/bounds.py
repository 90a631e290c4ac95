"""Filter and refine: exact top-k over vectors of one byte a component.

Every unit vector is kept as whole numbers from -127 to 127, one scale, and the length of what
rounding took away (``slack``). By Cauchy and Schwarz the score of a query and a row lies within

    scales * (codes . codes)  +-  (slack_row + slack_query * (1 + slack_row)),

so a block of codes tells which rows can still be among a query's best k: those whose highest
possible score reaches the k-th best of the lowest possible ones. Only these few pairs are
scored from the vectors. Nothing that could rank is left out, ties included.

Blocks of codes travel instead of vectors, an eighth of the bytes of doubles, and rows are left
out whether or not the vectors fall into clusters. Where the bounds cannot tell many rows apart
(a crowd of nearly equal vectors), the query is answered by the cells plan instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.lineage import cut_lineage
from vicinity.operators import knn

LEVELS = 127
#: Whole numbers up to this are exact in single precision.
EXACT_SINGLE = 1 << 24
BLOCK_ROWS = 1 << 15
SCORE_CELLS = 1 << 21
#: A query with more candidates than this many times ``k`` in one block is a crowded one.
CROWD = 16
#: Rows that are candidates of so many queries are looked up by broadcast, this many rows at most.
HOT_PAIRS = 1 << 14
HOT_ROWS = 1024

_CODES = T.StructType(
    [
        T.StructField("code", T.BinaryType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("slack", T.DoubleType()),
    ]
)
_FOUND = "_query bigint, _row bigint, low double, high double"


def compress(vectors: DataFrame) -> DataFrame:
    """``code``, ``scale`` and ``slack`` in place of ``embedding``; all other columns stay.

    Rows whose vector is null, empty, zero or not finite never match and are left out.
    """
    kept = [f for f in vectors.schema.fields if f.name != "embedding"]
    schema = T.StructType(kept + _CODES.fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = knn._matrix(batch.column("embedding"))
            usable = ~np.isnan(units).any(axis=1)
            batch, units = batch.filter(pa.array(usable)), units[usable]
            scale = np.abs(units).max(axis=1, initial=0.0) / LEVELS
            codes = np.rint(units / scale[:, None])
            slack = np.sqrt(np.square(units - codes * scale[:, None]).sum(axis=1))
            ends = np.arange(len(codes) + 1, dtype=np.int32) * units.shape[1]
            code = pa.Array.from_buffers(
                pa.binary(), len(codes),
                [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.astype(np.int8).tobytes())],
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), code, pa.array(scale), pa.array(slack)],
                names=schema.names,
            )

    return vectors.filter(F.size("embedding") > 0).mapInArrow(run, schema)


# --- kernel ----------------------------------------------------------------------------


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as a matrix of floats in which their products are exact, scales, slacks."""
    raw = b"".join(table.column("code").to_pylist())
    codes = np.frombuffer(raw, dtype=np.int8).reshape(table.num_rows, -1)
    exact = codes.shape[1] * LEVELS * LEVELS < EXACT_SINGLE
    return (
        codes.astype(np.float32 if exact else np.float64),
        table.column("scale").to_numpy(),
        table.column("slack").to_numpy(),
    )


def _candidates(queries: pa.Table, rows: pa.Table, k: int, min_score: float) -> pa.Table:
    """Pairs of this block that can be among a query's best ``k``, with the bounds of their score.

    A crowded query gives one line without a row instead.
    """
    found: list[tuple] = []
    if queries.num_rows and rows.num_rows:
        excludes = any(c in queries.column_names for c in knn._EXCLUDES)
        spans = [()] * queries.num_rows
        if excludes:
            rows = rows.sort_by("path")
            spans = knn._excluded_cells(queries, rows.column("path").combine_chunks())
        left, left_scale, left_slack = _codes(queries)
        right, scale, slack = _codes(rows)
        names, held = queries.column("_query").to_numpy(), rows.column("_row").to_numpy()
        step = max(1, SCORE_CELLS // len(right))
        for a in range(0, len(left), step):
            b = min(a + step, len(left))
            middle = (left[a:b] @ right.T) * left_scale[a:b, None] * scale
            margin = left_slack[a:b, None] * (1 + slack) + (slack + knn.SLACK)
            for line, cut in enumerate(spans[a:b]):
                for x, y in cut:
                    middle[line, x:y] = -np.inf
            low = middle - margin
            floor = np.full(b - a, min_score)
            if len(right) > k:
                kth = np.partition(low, len(right) - k, axis=1)[:, len(right) - k]
                floor = np.maximum(floor, kth)
            high = middle + margin
            live = high >= floor[:, None]
            crowd = live.sum(axis=1) > CROWD * k
            live[crowd] = False
            qi, ri = np.nonzero(live)
            found.append((names[a:b][qi], held[ri], low[qi, ri], high[qi, ri], np.zeros(len(qi), bool)))
            many = names[a:b][crowd]
            rest = np.zeros(len(many))
            found.append((many, np.zeros(len(many), np.int64), rest, rest, np.ones(len(many), bool)))
    if not found:
        found.append((np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * 2, np.zeros(0, bool)))
    query, row, low, high, none = (np.concatenate(part) for part in zip(*found))
    return pa.table(
        [pa.array(query), pa.array(row, mask=none), pa.array(low), pa.array(high)],
        names=["_query", "_row", "low", "high"],
    )


def _scored(pairs: DataFrame, ids: list[str], schema: T.StructType, min_score: float) -> DataFrame:
    """Scores of joined pairs from their vectors, one pair at a time as in the other plans."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = knn._matrix(batch.column("_asked")), knn._matrix(batch.column("_held"))
            score = np.round(np.einsum("ij,ij->i", left, right), knn.SCORE_DECIMALS) + 0.0
            hits = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*ids, "path", "chunk_index")), pa.array(score)],
                names=schema.names,
            )
            yield hits.filter(pa.array(score >= min_score))

    return pairs.mapInArrow(run, schema)


# --- plan ------------------------------------------------------------------------------


def _block_counts(queries: int, rows: int, per_block: int, partitions: int) -> tuple[int, int]:
    """Blocks of queries and of rows: bounded ones, and enough pairs of them for all partitions."""
    row_blocks = max(1, math.ceil(rows / per_block))
    wanted = math.ceil(partitions / row_blocks)
    most = max(1, queries // knn.MIN_BLOCK_ROWS)
    return max(1, math.ceil(queries / per_block), min(wanted, most)), row_blocks


def _scan(queries: DataFrame, rows: DataFrame, k: int, min_score: float, per_block: int) -> DataFrame:
    """Candidates of all blocks of queries against all blocks of rows."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    excludes = [c for c in knn._EXCLUDES if c in queries.columns]
    parts, row_parts = _block_counts(queries.count(), rows.count(), per_block, partitions)

    def own(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = compress(queries.select("_query", *excludes, "embedding"))
    held = compress(rows.select("_row", *(["path"] if excludes else []), "embedding"))
    asked = asked.withColumn("query_block", own("_query", parts)).withColumn("row_block", every(row_parts))
    held = held.withColumn("row_block", own("_row", row_parts)).withColumn("query_block", every(parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _candidates(left, right, k, min_score)

    key = ["query_block", "row_block"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, _FOUND)


def _with_vectors(pairs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Path, number and vector of each pair's row; rows near to very many queries by broadcast."""
    held = rows.select("_row", "path", "chunk_index", F.col("embedding").alias("_held"))
    share = max(HOT_PAIRS, total // HOT_ROWS)
    hot = [r._row for r in pairs.groupBy("_row").count().filter(F.col("count") > share).collect()]
    if not hot:
        return pairs.join(held, "_row")
    is_hot = F.col("_row").isin(hot)
    near = pairs.filter(is_hot).join(F.broadcast(held.filter(is_hot)), "_row")
    return near.unionByName(pairs.filter(~is_hot).join(held.filter(~is_hot), "_row"))


def bounds_plan(
    queries: DataFrame, ids: list[str], index: DataFrame, k: int, min_score: float,
    per_block: int | None, cell_rows: int,
) -> DataFrame:
    """Hits as ``knn_chunks`` gives them. Runs the scan of the codes when it is called."""
    queries = cut_lineage(queries.withColumn("_query", F.monotonically_increasing_id()))
    rows = knn.rows_in_reach(index, k, knn.most_excluded(queries))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = cut_lineage(_scan(queries, rows, k, min_score, per_block or BLOCK_ROWS))
    total, crowded = found.agg(F.count("*"), F.count_if(F.col("_row").isNull())).first()

    pairs = found.filter(F.col("_row").isNotNull())
    lows = Window.partitionBy("_query").orderBy(F.desc("low"))
    secured = pairs.withColumn("_nth", F.row_number().over(lows)).filter(F.col("_nth") == k)
    secured = secured.select("_query", F.col("low").alias("reach"))
    live = pairs.join(secured, "_query", "left").filter("reach IS NULL OR high >= reach")
    live = live.select("_query", "_row")
    if crowded:
        many = found.filter(F.col("_row").isNull()).select("_query").distinct()
        live = live.join(many, "_query", "left_anti")
    asked = queries.select("_query", *ids, F.col("embedding").alias("_asked"))
    joined = _with_vectors(live, rows, total).join(asked, "_query")
    hits = _scored(joined, ids, knn._hit_schema(queries, ids), min_score)
    hits = knn.top_hits(hits, ids, k)
    if crowded:
        rest = queries.join(many, "_query", "left_semi").drop("_query")
        hits = hits.unionByName(knn._cells_plan(rest, ids, index, k, min_score, None, cell_rows))
    return hits
