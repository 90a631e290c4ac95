"""Keep an index current from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinity.functions.vectors import validate_chunks
from vicinity.lineage import cut_lineage
from vicinity.operators.changes import (
    diff_snapshot,
    note_outcomes,
    resolve_rename,
    route_failures,
    state_delta,
)
from vicinity.operators.embedding import probe_dim
from vicinity.operators.index import index_notes, lookup_paths, other_paths, rename_notes, stamp
from vicinity.schema import CHANGES, ERRORED, EVENTS, INDEX, STATE, Options, columns
from vicinity.sources.tables import (
    INDEX_TABLE,
    is_stored,
    read_current,
    read_paths,
    write_change,
    writing,
)
from vicinity.streaming.feed import filter_events, last_touches
from vicinity.streaming.timers import as_events, settle, tried_again

_REASON = {"create": "new", "modify": "modified", "delete": "deleted"}


# Tables below the root of a maintained index, in the order they are written. The state comes
# last: what it holds as done has been done.
TABLES = {INDEX_TABLE: INDEX, "errored": ERRORED, "retry": CHANGES, "state": STATE}
_AGAIN = EVENTS + ", attempts INT"


def events_to_changes(events: DataFrame, state: DataFrame, patterns=()) -> DataFrame:
    """Changes of a batch of events: last per path, renames resolved.

    Of the state only the paths that renames leave are read.
    """
    touches = cut_lineage(last_touches(events))
    last = touches.filter("stays")
    reason = F.create_map(*[F.lit(x) for pair in _REASON.items() for x in pair])
    plain = last.filter(F.col("kind") != "rename").select(
        "path",
        reason[F.col("kind")].alias("reason"),
        F.when(F.col("kind") != "delete", F.col("mtime")).alias("mtime"),
        F.lit(None).cast("string").alias("old_path"),
        F.lit(None).cast("int").alias("attempts"),
    )
    renames = last.filter(F.col("kind") == "rename").select("old_path", "path", "mtime")
    known = lookup_paths(state, renames.select(F.col("old_path").alias("path")))
    resolved = resolve_rename(renames, known, patterns)
    # A path that a rename leaves and a later event fills again keeps the later event.
    resolved = resolved.join(
        plain.select("path"), "path", "left_anti"
    ).select(*columns(CHANGES))
    # The start of a chain of renames is left by a rename that is itself superseded.
    left = touches.filter("NOT stays").join(
        renames.select(F.col("old_path").alias("path")), "path", "left_anti"
    )
    gone = left.select(
        "path",
        F.lit("deleted").alias("reason"),
        F.lit(None).cast("bigint").alias("mtime"),
        F.lit(None).cast("string").alias("old_path"),
        F.lit(None).cast("int").alias("attempts"),
    )
    return plain.unionByName(resolved).unionByName(gone)


def apply_changes(
    spark: SparkSession,
    changes: DataFrame,
    root: str,
    notes: DataFrame,
    embedder,
    options: Options = Options(),
    at=None,
    stream: str | None = None,
    batch: int | None = None,
    again: str | None = None,
) -> None:
    """Process one set of changes and store the outcome.

    No other writer is at work on the root meanwhile, so what is read here still holds when the
    outcome is written. A batch of a stream that has been stored is skipped. Failed notes are
    kept in the table ``retry`` for the next call until their attempts run out; with ``again``
    they are written to that folder as events instead, for a stream that gives them out later.
    """
    with writing(spark, root, stream):
        if stream is None or not is_stored(spark, root, stream, batch):
            _apply(spark, changes, root, notes, embedder, options, at, stream, batch, again)


def _apply(spark, changes, root, notes, embedder, options, at, stream, batch, again) -> None:
    def stored(paths: DataFrame) -> DataFrame:
        return read_paths(spark, root, INDEX_TABLE, INDEX, paths)

    waiting = read_current(spark, root, "retry", CHANGES)
    changes = changes.select(*columns(CHANGES))
    waiting = waiting.join(changes.select("path"), "path", "left_anti").select(*columns(CHANGES))
    todo = cut_lineage(changes.unionByName(waiting))

    renames = todo.filter((F.col("reason") == "renamed") & F.col("old_path").isNotNull())
    leaving = stored(renames.select(F.col("old_path").alias("path")))
    moved, unmatched = rename_notes(leaving, renames.select("old_path", "path"), at)
    moved = moved.select(*columns(INDEX))
    broken = todo.filter((F.col("reason") == "renamed") & F.col("old_path").isNull())
    updates = (
        todo.filter(F.col("reason").isin("new", "modified")).select("path")
        .unionByName(unmatched.select("path"))
        .unionByName(broken.select("path"))
    )

    # The one expensive step: its rows feed the index, the state and the failures.
    known = None
    if options.reuse_vectors:
        known = read_paths(spark, root, INDEX_TABLE, INDEX, updates, only=False)
        known = None if known.isEmpty() else known
    made = cut_lineage(
        index_notes(lookup_paths(notes, updates), embedder, options, stored=known)
    )
    outcomes = note_outcomes(made)
    good = outcomes.filter("ok").select("path")
    failed = outcomes.filter(~F.col("ok"))
    valid, _ = validate_chunks(other_paths(made, failed), probe_dim(embedder))
    fresh = stamp(valid.drop("error"), at).select(*columns(INDEX))

    deleted = todo.filter(F.col("reason") == "deleted").select("path")
    replaced = deleted.unionByName(good).unionByName(renames.select(F.col("old_path").alias("path")))
    if options.on_empty == "delete":
        replaced = replaced.unionByName(
            updates.join(made.select("path"), "path", "left_anti")
        )
    # All rows of a path are written at once, so chunks that stand at the target of a move go along.
    standing = stored(moved.select("path")).join(replaced.select("path"), "path", "left_anti")
    done = todo.join(failed.select("path"), "path", "left_anti")
    gone, kept = state_delta(done)
    once_more, dead = route_failures(
        todo.join(failed.select("path", "error"), "path"), options.max_attempts, at
    )
    if again is not None:
        # Before the batch is noted as stored; a batch that runs again writes the same file again.
        as_events(once_more, at).select(*columns(_AGAIN)).write.mode("overwrite").parquet(f"{again}/{batch:012d}")
        once_more = once_more.limit(0)
    touched = todo.select("path")
    write_change(
        spark,
        root,
        {
            INDEX_TABLE: (INDEX, fresh.unionByName(moved).unionByName(standing), replaced),
            "errored": (ERRORED, dead.select(*columns(ERRORED)), touched),
            "retry": (CHANGES, once_more, touched),
            "state": (STATE, kept.select(*columns(STATE)), gone),
        },
        stream=stream,
        batch=batch,
    )


def retry_waiting(
    spark: SparkSession, root: str, notes: DataFrame, embedder, options: Options = Options(), at=None
) -> None:
    """Try the failed notes that wait once more, without a new event."""
    if not read_current(spark, root, "retry", CHANGES).isEmpty():
        nothing = spark.createDataFrame([], CHANGES)
        apply_changes(spark, nothing, root, notes, embedder, options, at)


def reconcile(
    spark: SparkSession, root: str, notes: DataFrame, embedder, options: Options = Options(), at=None
) -> None:
    """Bring a root in line with the notes as they are.

    Finds by the snapshot diff what events have missed, or came too late, and what
    failed before and was edited since. To be run before a stream starts.
    """
    state, errored = (read_current(spark, root, t, TABLES[t]) for t in ("state", "errored"))
    todo = diff_snapshot(notes, state, errored, options.exclude_globs)
    apply_changes(spark, todo, root, notes, embedder, options, at)


def index_stream(
    events: DataFrame,
    root: str,
    notes: Callable[[], DataFrame],
    embedder,
    checkpoint: str,
    options: Options = Options(),
    trigger: dict | None = None,
    retry_seconds: float = 1,
) -> StreamingQuery:
    """Run ``apply_changes`` on every micro-batch of an event stream.

    Events of other files and of excluded paths are left out. An edit is held until its path
    has been quiet for ``indexing_delay_seconds``. A failed note waits in keyed state for its
    next try, ``retry_seconds`` and then twice as long, and needs no event to get it; an event of its
    path takes its place. Both waits outlast a restart. A stream that ends by itself, with
    the trigger ``availableNow`` or ``once``, holds nothing back: edits count once per batch and failed
    notes are tried with the next batch.

    ``notes`` is called per batch, so each batch reads the notes as they are by then. By default a batch is begun
    every second. The name of the stream is the one its checkpoint keeps, so a stream on a new checkpoint
    never takes its batches for those of an earlier one.
    """
    spark = events.sparkSession
    ends = bool({"availableNow", "once"} & set(trigger or {}))
    again = None if ends else f"{checkpoint}/again"

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.read.schema("id STRING").json(f"{checkpoint}/metadata").first()["id"]
        # Run once whatever follows: the state of the waits is brought forward by this.
        batch = cut_lineage(batch)
        if batch.isEmpty():
            return
        fresh = batch if ends else batch.filter("attempts IS NULL")
        left = fresh.filter("kind = 'rename'").select(F.col("old_path").alias("path"))
        known = read_paths(session, root, "state", STATE, left)
        changes = events_to_changes(fresh, known, options.exclude_globs)
        if not ends:
            tried = tried_again(batch).join(changes.select("path"), "path", "left_anti")
            changes = changes.unionByName(tried.select(*changes.columns))
        apply_changes(
            session, changes, root, notes(), embedder, options, stream=stream, batch=batch_id, again=again
        )

    shown = filter_events(events, options.exclude_globs)
    if not ends:
        path = spark._jvm.org.apache.hadoop.fs.Path(again)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        failed = spark.readStream.schema(_AGAIN).option("recursiveFileLookup", "true").parquet(again)
        known = shown.select(*columns(EVENTS)).withColumn("attempts", F.lit(None).cast("int"))
        shown = settle(known.unionByName(failed), options.indexing_delay_seconds, retry_seconds=retry_seconds)
    writer = shown.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
