"""What has to be done: snapshot diffs, renames, commits, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.globs import exclude_paths, is_excluded
from vicinity.functions.text import normalized_text
from vicinity.schema import CHANGES, ERRORED, MAX_ATTEMPTS, columns


def list_snapshot(notes: DataFrame) -> DataFrame:
    """``path, mtime`` of the markdown notes."""
    return notes.select("path", "mtime").filter(F.col("path").endswith(".md"))


def _changes(df: DataFrame, **given) -> DataFrame:
    """Rows in the shape of the changes table; absent fields are null."""
    types = {"path": "string", "reason": "string", "mtime": "bigint", "old_path": "string",
             "attempts": "int"}
    return df.select(
        *[
            given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
            for c in columns(CHANGES)
        ]
    )


# --- snapshot diff ----------------------------------------------------------------------


def diff_snapshot(
    notes: DataFrame,
    state: DataFrame,
    errored: DataFrame,
    patterns=(),
    check_mtime: bool = True,
) -> DataFrame:
    """Changes that bring the index in line with the corpus.

    Corpus, state and failures are stacked and gathered by path with one aggregation:
    every row is shuffled once, nothing is sorted, and each side needs only its path and
    mtime. A path that is not in the state and failed before at the same mtime is
    skipped; a path in the state is not looked up among the failures.
    """
    yes = F.lit(True)
    live = exclude_paths(list_snapshot(notes), patterns)
    stacked = (
        live.select("path", yes.alias("live"), F.col("mtime").alias("live_mtime"))
        .unionByName(
            state.select("path", yes.alias("known"), F.col("mtime").alias("known_mtime")), True
        )
        .unionByName(errored.select("path", F.col("mtime").alias("failed_mtime")), True)
    )
    sides = stacked.groupBy("path").agg(
        *[F.bool_or(c).alias(c) for c in ("live", "known")],
        *[F.max(c).alias(c) for c in ("live_mtime", "known_mtime", "failed_mtime")],
    )
    same_failure = F.coalesce(F.col("failed_mtime") == F.col("live_mtime"), F.lit(False))
    reason = F.when(F.col("live").isNull(), F.when(F.col("known"), "deleted")).when(
        F.col("known").isNull(), F.when(~same_failure, "new")
    )
    if check_mtime:
        edited = ~F.col("known_mtime").eqNullSafe(F.col("live_mtime"))
        reason = reason.when(edited, "modified")
    found = sides.select("path", reason.alias("reason"), F.col("live_mtime").alias("mtime"))
    return _changes(found.filter(F.col("reason").isNotNull()))


def cleared_by_diff(notes: DataFrame, state: DataFrame, errored: DataFrame, patterns=()) -> DataFrame:
    """Failures the diff drops: the note is not indexed and was edited since."""
    live = exclude_paths(list_snapshot(notes), patterns).withColumnRenamed("mtime", "live_mtime")
    return (
        errored.join(live, "path")
        .join(state.select("path"), "path", "left_anti")
        .filter(~F.col("mtime").eqNullSafe(F.col("live_mtime")))
        .select(*errored.columns)
    )


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row ``added, removed, updated``."""
    def n(reason):
        return F.count_if(F.col("reason") == reason)

    return changes.agg(
        n("new").alias("added"), n("deleted").alias("removed"), n("modified").alias("updated")
    )


def apply_exclusions(notes: DataFrame, state: DataFrame, errored: DataFrame, patterns) -> DataFrame:
    """Changes after the exclusion patterns changed; mtimes are not compared."""
    return diff_snapshot(notes, state, errored, patterns, check_mtime=False)


def preview_exclusions(notes: DataFrame, state: DataFrame, errored: DataFrame, patterns) -> DataFrame:
    """One row ``removed, added`` without touching anything."""
    counts = diff_counts(apply_exclusions(notes, state, errored, patterns))
    return counts.select("removed", "added")


def all_notes_as_changes(notes: DataFrame, patterns=()) -> DataFrame:
    """Every included note as ``modified``. The failures table is to be emptied."""
    return _changes(exclude_paths(list_snapshot(notes), patterns), reason=F.lit("modified"))


def retry_errored(errored: DataFrame, notes: DataFrame) -> DataFrame:
    """Failed notes that still exist, as ``modified``; exclusions are not applied again."""
    return _changes(
        errored.select("path").join(notes.select("path", "mtime"), "path"),
        reason=F.lit("modified"),
    )


# --- renames and commits ------------------------------------------------------------------


def resolve_rename(events: DataFrame, state: DataFrame, patterns=()) -> DataFrame:
    """Changes of rename events ``(old_path, path, mtime)``.

    A target that is excluded only deletes the old path. If the stored mtime of the old
    path is the current one, the vectors move along; otherwise the old path is deleted
    and the new one is indexed.
    """
    stored = state.select(F.col("path").alias("old_path"), F.col("mtime").alias("stored"))
    gone = F.struct(
        F.col("old_path").alias("path"), F.lit("deleted").alias("reason"),
        F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("string").alias("old_path"),
    )
    moved = F.struct(
        F.col("path"), F.lit("renamed").alias("reason"), F.col("mtime"), F.col("old_path")
    )
    fresh = F.struct(
        F.col("path"), F.lit("new").alias("reason"), F.col("mtime"),
        F.lit(None).cast("string").alias("old_path"),
    )
    outcome = (
        F.when(is_excluded("path", patterns), F.array(gone))
        .when(F.col("stored") == F.col("mtime"), F.array(moved))
        .otherwise(F.array(gone, fresh))
    )
    return _changes(
        events.join(stored, "old_path", "left")
        .select(F.explode(outcome).alias("change"))
        .select("change.*")
    )


def commit_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """State after the changes in ``done`` succeeded.

    ``deleted`` drops the path, ``renamed`` drops the old path and sets the new one, the
    others set their mtime. An absent or zero mtime sets nothing.
    """
    gone, kept = state_delta(done)
    return (
        state.join(gone, "path", "left_anti")
        .join(kept.select("path"), "path", "left_anti")
        .unionByName(kept)
    )


def state_delta(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths the changes drop from the state, and the rows they set."""
    gone = (
        done.filter(F.col("reason").isin("deleted", "renamed"))
        .select(F.when(F.col("reason") == "deleted", F.col("path"))
                .otherwise(F.col("old_path")).alias("path"))
        .filter(F.col("path").isNotNull())
        .distinct()
    )
    kept = (
        done.filter((F.col("reason") != "deleted") & (F.col("mtime") != 0))
        .groupBy("path")
        .agg(F.max("mtime").alias("mtime"))
    )
    return gone, kept


def commit_errored(errored: DataFrame, done: DataFrame) -> DataFrame:
    """Failures left after success: a processed path is no longer errored."""
    return errored.join(done.select("path").distinct(), "path", "left_anti")


def clear_errored(errored: DataFrame, changes: DataFrame) -> DataFrame:
    """Failures left after fresh edits: creating or editing a note gives it a new start."""
    edited = changes.filter(F.col("reason").isin("new", "modified")).select("path").distinct()
    return errored.join(edited, "path", "left_anti")


# --- failures -------------------------------------------------------------------------------


def note_outcomes(embedded: DataFrame) -> DataFrame:
    """``path, ok, error``: a note succeeded only if all of its chunks did."""
    return embedded.groupBy("path").agg(
        F.bool_and(F.col("error").isNull()).alias("ok"), F.max("error").alias("error")
    )


def route_failures(
    outcomes: DataFrame, max_attempts: int = MAX_ATTEMPTS, at=None
) -> tuple[DataFrame, DataFrame]:
    """Failed changes to try again, and those that failed for the last time.

    ``outcomes`` are changes with ``error``; rows without one are ignored.
    """
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    failed = outcomes.filter(F.col("error").isNotNull()).withColumn(
        "attempts", F.coalesce("attempts", F.lit(0)) + 1
    )
    again = _changes(failed.filter(F.col("attempts") < max_attempts))
    dead = (
        failed.filter(F.col("attempts") >= max_attempts)
        .withColumn("last_tried_at", when)
        .select(*columns(ERRORED))
    )
    return again, dead


# --- options: embed less -------------------------------------------------------------------


def _embedded_hash() -> F.Column:
    """Hash of what was embedded; the first chunk's vector depends on the title too."""
    title = F.when(F.col("chunk_index") == 0, F.coalesce("title", F.lit(""))).otherwise("")
    return F.unhex(F.sha2(F.concat_ws("\u0000", title, F.col("content")), 256))


def with_stored_vectors(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks with ``embedding``: the stored vector where it is still right, or else null."""
    stored = index.select(
        "path", "chunk_index", _embedded_hash().alias("_hash"), "embedding"
    )
    return (
        chunks.drop("embedding")
        .withColumn("_hash", _embedded_hash())
        .join(stored, ["path", "chunk_index", "_hash"], "left")
        .drop("_hash")
    )


def reuse_embeddings(chunks: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose stored vector is still right, with it, and chunks left to embed."""
    matched = with_stored_vectors(chunks, index)
    return (
        matched.filter(F.col("embedding").isNotNull()),
        matched.filter(F.col("embedding").isNull()).drop("embedding"),
    )


def significant_change(old: F.Column, new: F.Column, ratio: float = 0.02) -> F.Column:
    """False when texts are equal up to white space or their lengths nearly agree.

    An edit that keeps the length counts as insignificant.
    """
    shift = F.abs(F.length(new) - F.length(old)) / F.greatest(F.length(old), F.lit(1))
    return (normalized_text(old) != normalized_text(new)) & (shift >= ratio)
