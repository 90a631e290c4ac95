"""Keyed tables in buckets of the path that change by overwriting whole buckets.

Layout below a root: ``<table>/bucket=K`` with ordinary Parquet files, and ``_buckets/N`` for the
number of buckets, which is fixed when the root is made. A change gives, for each table, paths
and the rows that replace all rows of these paths. The new contents of every bucket it touches
are written aside first; only when those of all tables are there, they take the place of the
old ones. A writer that dies before leaves the tables as they were, one that
dies later has the rest done by the next writer.

One writer is at work on a root at a time; others wait for it. A reader sees each bucket before
or after a change, and should be started again if files it reads are replaced meanwhile. The cost
of a change is the size of the buckets it touches, so large roots want many buckets.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators.index import FEW_PATHS, get_by_paths, other_paths, stamp
from vicinity.schema import INDEX, columns

INDEX_TABLE = "index"
#: Last batch of each stream that has been stored, under the stream's name.
BATCHES_TABLE, BATCHES = "batches", "path STRING, mtime BIGINT"
#: Buckets of a new root. A bucket should not be much larger than what one job likes to rewrite.
BUCKETS = 16
#: Seconds a writer waits for another one.
PATIENCE = 3600

_held: dict[str, threading.RLock] = defaultdict(threading.RLock)
_depth: dict[str, int] = defaultdict(int)


# --- files --------------------------------------------------------------------------------


def _files(spark: SparkSession, root: str):
    """The file system of a root and a maker of paths below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: path(f"{root}/{p}")


def bucket_count(spark: SparkSession, root: str, new: int | None = None) -> int:
    """Buckets of a root; one that is not there yet gets ``new``."""
    files, at = _files(spark, root)
    if files.exists(at("_buckets")):
        return int(files.listStatus(at("_buckets"))[0].getPath().getName())
    count = new or BUCKETS
    files.mkdirs(at(f"_buckets/{count}"))
    return count


def bucket_of(path: str | Column, count: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(count)).cast("int")


@contextmanager
def writing(spark: SparkSession, root: str, owner: str | None = None, patience: float = PATIENCE):
    """Be the only writer of a root; may be entered again by the same thread.

    Threads of one driver wait for each other in memory, drivers by a file that only one can
    create and that names its ``owner``. A stream that comes back after its driver died
    takes its own file over; the file of any other dead writer has to be deleted by hand, as
    ``TimeoutError`` says after ``patience`` seconds. What a dead writer left half done is done first.
    """
    with _held[root]:
        if _depth[root] == 0:
            _take(spark, root, owner or uuid.uuid4().hex, patience)
        _depth[root] += 1
        try:
            if _depth[root] == 1:
                finish(spark, root)
            yield
        finally:
            _depth[root] -= 1
            if _depth[root] == 0:
                files, at = _files(spark, root)
                files.delete(at("_writer"), False)


def _take(spark: SparkSession, root: str, owner: str, patience: float) -> None:
    files, at = _files(spark, root)
    until = time.monotonic() + patience
    while True:
        try:
            out = files.create(at("_writer"), False)
            out.writeUTF(owner)
            out.close()
            return
        except Py4JJavaError:
            if not files.exists(at("_writer")) and time.monotonic() > until:
                raise
        if _owner(files, at) == owner:
            return
        if time.monotonic() > until:
            raise TimeoutError(f"{root}/_writer is held by another writer; delete it if that one is dead")
        time.sleep(0.05)


def _owner(files, at) -> str | None:
    try:
        stream = files.open(at("_writer"))
        name = stream.readUTF()
        stream.close()
        return name
    except Py4JJavaError:  # gone, or not written yet
        return None


# --- reading ------------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(f"{ddl}, bucket INT").parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ddl}, bucket INT")


def read_current(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    """All rows of a table."""
    return _read(spark, f"{root}/{table}", ddl).select(*columns(ddl))


def read_paths(spark: SparkSession, root: str, table: str, ddl: str, paths: DataFrame,
               few: int = FEW_PATHS, only: bool = True) -> DataFrame:
    """Rows of the given paths; buckets without any of them are not opened.

    A bounded fetch finds out whether the paths are few. If so they become a filter that
    reaches the scan; otherwise they are joined, and the buckets are chosen when the join runs.
    Without ``only`` rows of other paths may come along instead, for a caller that joins by path itself.
    """
    rows, count = _read(spark, f"{root}/{table}", ddl), bucket_count(spark, root)
    keyed = paths.select("path", bucket_of("path", count).alias("bucket")).distinct()
    wanted = keyed.limit(few + 1).collect()
    if len(wanted) <= few:
        buckets = sorted({r.bucket for r in wanted})
        found = rows.filter(F.col("bucket").isin(buckets) & F.col("path").isin([r.path for r in wanted]))
    else:
        buckets = [r.bucket for r in keyed.select("bucket").distinct().collect()]
        found = rows.filter(F.col("bucket").isin(buckets))
        found = get_by_paths(found, keyed) if only else found
    return found.select(*columns(ddl))


def is_stored(spark: SparkSession, root: str, stream: str, batch: int) -> bool:
    """Whether this batch of the stream, or a later one, has been stored."""
    last = read_current(spark, root, BATCHES_TABLE, BATCHES).filter(F.col("path") == stream)
    row = last.first()
    return row is not None and row.mtime >= batch


# --- writing ------------------------------------------------------------------------------


def _bucketed(rows: DataFrame, path: str, count: int) -> None:
    """Add rows to a folder by bucket. The hint lets a bucket that is much larger than others
    have several tasks, such as one with a note of very many chunks."""
    (
        rows.withColumn("bucket", bucket_of("path", count)).hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "path").write.mode("append").partitionBy("bucket").parquet(path)
    )


def _buckets_at(files, folder) -> set[int]:
    if not files.exists(folder):
        return set()
    names = (s.getPath().getName() for s in files.listStatus(folder))
    return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}


def write_change(spark: SparkSession, root: str, tables: dict[str, tuple[str, DataFrame, DataFrame | None]],
                 stream: str | None = None, batch: int | None = None, buckets: int | None = None) -> None:
    """Store one change: per table its schema, its new rows, and further paths that go.

    All rows of a path are replaced by the new ones it has. New rows are computed once. Tables are
    overwritten in the order given, then the batch is noted; a batch that is noted already
    changes nothing.
    """
    with writing(spark, root, stream):
        count = bucket_count(spark, root, buckets)
        if stream is not None:
            if is_stored(spark, root, stream, batch):
                return
            note = spark.createDataFrame([(stream, batch)], BATCHES)
            tables = {**tables, BATCHES_TABLE: (BATCHES, note, None)}
        files, at = _files(spark, root)
        for table, (ddl, rows, removed) in tables.items():
            _stage(spark, root, count, table, ddl, rows, removed)
        for place, table in enumerate(tables):
            files.mkdirs(at(f"_ready/order/{place:03d}-{table}"))
        files.rename(at("_ready"), at("_staged/_ready"))
        finish(spark, root)


def _stage(spark, root, count, table, ddl, rows, removed) -> None:
    """Write the coming contents of the buckets that a change of a table touches: first the new
    rows, then those that stay beside them. A bucket that ends up empty is an empty folder."""
    files, at = _files(spark, root)
    path = f"{root}/_staged/{table}"
    _bucketed(rows.select(*columns(ddl)).filter("path IS NOT NULL"), path, count)
    touched = _buckets_at(files, at(f"_staged/{table}"))
    gone = spark.read.schema("path STRING, bucket INT").parquet(path).select("path")
    if removed is not None:
        keyed = removed.select("path", bucket_of("path", count).alias("bucket")).filter("path IS NOT NULL")
        touched |= {r.bucket for r in keyed.select("bucket").distinct().collect()}
        gone = gone.unionByName(keyed.select("path"))
    held = touched & _buckets_at(files, at(table))
    if held:
        old = _read(spark, f"{root}/{table}", ddl).filter(F.col("bucket").isin(sorted(held)))
        _bucketed(other_paths(old, gone).select(*columns(ddl)), path, count)
    for bucket in touched:
        files.mkdirs(at(f"_staged/{table}/bucket={bucket}"))


def finish(spark: SparkSession, root: str) -> None:
    """Put what is staged into place if it is whole, and clear it away.

    A bucket is moved into the place of the old one, so whatever is still staged is still to be
    done, and doing it again from any point gives the same.
    """
    files, at = _files(spark, root)
    if files.exists(at("_staged/_ready")):
        for entry in sorted(s.getPath().getName() for s in files.listStatus(at("_staged/_ready/order"))):
            _publish(spark, root, entry[4:])
    for left in ("_staged", "_ready"):
        files.delete(at(left), True)


def _publish(spark: SparkSession, root: str, table: str) -> None:
    files, at = _files(spark, root)
    files.mkdirs(at(table))
    for bucket in sorted(_buckets_at(files, at(f"_staged/{table}"))):
        place = at(f"{table}/bucket={bucket}")
        files.delete(place, True)
        if not files.rename(at(f"_staged/{table}/bucket={bucket}"), place):
            raise OSError(f"could not move bucket {bucket} of {table} into place below {root}")


# --- the index ------------------------------------------------------------------------------


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Stored chunks."""
    return read_current(spark, root, INDEX_TABLE, INDEX)


def stored_dim(spark: SparkSession, root: str) -> int | None:
    """Width of the stored vectors; an index has one. Reads no more rows than it takes to find one."""
    row = read_index(spark, root).select(F.size("embedding").alias("n")).first()
    return None if row is None else row["n"]


def _stamped(chunks: DataFrame, at, dim: int | None = None) -> DataFrame:
    """Index rows of the chunks that can be stored; others never fail a write."""
    rows = chunks if "last_updated" in chunks.columns else stamp(chunks, at)
    size = F.size("embedding")
    fits = size > 0 if dim is None else size == dim
    return rows.filter(fits).select(*columns(INDEX))


def write_index(chunks: DataFrame, root: str, removed: DataFrame | None = None,
                at=None, dim: int | None = None, buckets: int | None = None) -> None:
    """Store chunks: stamp them, replace the notes they belong to, drop ``removed``.

    Chunks without a vector, or with one that is not ``dim`` wide, by default as wide as those
    stored already, are left out; ``validate_chunks`` tells which.
    """
    spark = chunks.sparkSession
    with writing(spark, root):
        dim = stored_dim(spark, root) if dim is None else dim
        write_change(spark, root, {INDEX_TABLE: (INDEX, _stamped(chunks, at, dim), removed)}, buckets=buckets)


def overwrite_index(chunks: DataFrame, root: str, at=None, dim: int | None = None,
                    buckets: int | None = None) -> None:
    """Replace the whole index, as after a rebuild."""
    spark = chunks.sparkSession
    with writing(spark, root):
        old = read_index(spark, root).select("path")
        write_change(spark, root, {INDEX_TABLE: (INDEX, _stamped(chunks, at, dim), old)}, buckets=buckets)
