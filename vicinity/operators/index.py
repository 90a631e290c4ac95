"""The chunk index as a table: build it, replace, delete and rename notes in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.globs import exclude_paths
from vicinity.functions.text import (
    embed_text,
    exclude_content,
    nonempty_content,
    path_hash,
    strip_frontmatter,
)
from vicinity.lineage import cut_lineage
from vicinity.operators.changes import all_notes_as_changes, note_outcomes, with_stored_vectors
from vicinity.operators.chunking import chunk_notes
from vicinity.operators.embedding import embed_column
from vicinity.schema import INDEX, Options, columns

FEW_PATHS = 1000


def stamp(chunks: DataFrame, at=None) -> DataFrame:
    """Adds ``path_hash`` and ``last_updated``."""
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return chunks.withColumn("path_hash", path_hash("path")).withColumn("last_updated", when)


def upsert_notes(index: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by note: all old chunks of the paths in ``new`` go, the new ones come."""
    return delete_notes(index, new).unionByName(new)


def delete_notes(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Index without the chunks of the given paths."""
    return index.join(paths.select("path").distinct(), "path", "left_anti")


def removed_counts(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Per requested path: chunks that a delete removes, and whether there are any."""
    held = index.join(paths.select("path"), "path", "left_semi").groupBy("path").agg(
        F.count("*").alias("chunks")
    )
    return (
        paths.select("path")
        .distinct()
        .join(held, "path", "left")
        .select(
            "path",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.col("chunks").isNotNull().alias("removed"),
        )
    )


def rename_notes(index: DataFrame, renames: DataFrame, at=None) -> tuple[DataFrame, DataFrame]:
    """Move chunks from ``old_path`` to ``path``; vectors and titles stay as they are.

    Returns the new index and the renames whose old path had no chunks, which have to
    be embedded from their content. So have all but the last by path of several renames
    of one old path, whose chunks move once. Chunks standing at a target path stay, as in a move
    onto an existing note.
    """
    moves = renames.groupBy("old_path").agg(F.max("path").alias("new_path"))
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    moved = F.col("new_path").isNotNull()
    joined = index.join(moves, index["path"] == moves["old_path"], "left").drop("old_path")
    renamed = joined.select(
        *[
            F.when(moved, F.col("new_path")).otherwise(F.col("path")).alias("path")
            if c == "path"
            else F.when(moved, path_hash("new_path")).otherwise(F.col(c)).alias(c)
            if c == "path_hash"
            else F.when(moved, when).otherwise(F.col(c)).alias(c)
            if c == "last_updated"
            else F.col(c)
            for c in index.columns
        ]
    )
    held = index.select(F.col("path").alias("old_path"))
    other = renames.join(moves, "old_path").filter("path <> new_path").select(*renames.columns)
    return renamed, renames.join(held, "old_path", "left_anti").unionByName(
        other.join(held, "old_path", "left_semi").select(*renames.columns)
    )


def get_by_path(index: DataFrame, path: str) -> DataFrame:
    """All chunks of one note, with vectors. The filter reaches the scan."""
    return index.filter(F.col("path") == path)


def get_by_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """All chunks of many notes."""
    return index.join(paths.select("path"), "path", "left_semi")


def lookup_paths(table: DataFrame, paths: DataFrame, few: int = FEW_PATHS) -> DataFrame:
    """Rows of the given paths, for changes of any size to large tables.

    Bounded fetches find out whether the paths are few, or the other paths of the table. If so
    they become a filter that reaches the scan, where sorted files skip nearly everything, and
    no row is shuffled; otherwise a join is used.
    """
    wanted = _few_paths(paths, few)
    if wanted is not None:
        return table.filter(F.col("path").isin(wanted))
    table = table.filter(F.col("path").isNotNull())
    others = _few_paths(delete_notes(table.select("path"), paths), few)
    if others is not None:
        return table.filter(~F.col("path").isin(others))
    return get_by_paths(table, paths)


def other_paths(table: DataFrame, paths: DataFrame, few: int = FEW_PATHS) -> DataFrame:
    """Rows of all but the given paths, by the same means as ``lookup_paths``."""
    unwanted = _few_paths(paths.filter(F.col("path").isNotNull()), few)
    if unwanted is not None:
        return table.filter(F.col("path").isNull() | ~F.col("path").isin(unwanted))
    left = _few_paths(delete_notes(table.select("path").filter(F.col("path").isNotNull()), paths), few)
    if left is not None:
        return table.filter(F.col("path").isNull() | F.col("path").isin(left))
    return delete_notes(table, paths)


def _few_paths(paths: DataFrame, few: int) -> list[str] | None:
    """The different paths if there are at most so many."""
    found = paths.select("path").distinct().limit(few + 1).collect()
    return [r["path"] for r in found] if len(found) <= few else None


def count_chunks(index: DataFrame) -> DataFrame:
    """Number of stored chunks."""
    return index.agg(F.count("*").alias("chunks"))


def prepare_notes(notes: DataFrame, options: Options = Options()) -> DataFrame:
    """Content as it is indexed: frontmatter and unwanted matches removed."""
    content = F.col("content")
    if not options.include_frontmatter:
        content = strip_frontmatter(content)
    kept = nonempty_content(notes.withColumn("content", content))
    if not options.exclude_regexes:
        return kept
    return nonempty_content(
        kept.withColumn("content", exclude_content("content", options.exclude_regexes))
    )


def note_chunks(notes: DataFrame, options: Options = Options(),
                max_tokens: int | None = None, partitions: int | None = None) -> DataFrame:
    """Chunks of prepared notes with the ``text`` to embed."""
    size = min(options.chunk_size, max_tokens or options.chunk_size)
    notes = notes.select("path", "title", "content")
    if partitions:
        notes = notes.repartition(partitions)
    chunks = chunk_notes(
        prepare_notes(notes, options), size, options.chunk_overlap, options.counter
    )
    return chunks.withColumn("text", embed_text("title", "content", "chunk_index"))


def index_notes(
    notes: DataFrame,
    embedder,
    options: Options = Options(),
    changes: DataFrame | None = None,
    partitions: int | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Chunks with ``embedding`` and ``error`` for the notes that changed.

    One narrow plan from notes to vectors; the only shuffle is the join with
    ``changes``. ``partitions`` spreads the notes before they are prepared and the chunks
    before they are embedded, so that neither few large partitions nor one very long
    note hold up the model. Chunks that are what they are among ``stored``, index rows of
    the same notes, take their vectors from there and do not go to the model.
    """
    if changes is not None:
        wanted = changes.filter(F.col("reason").isin("new", "modified")).select("path")
        notes = notes.join(wanted, "path", "left_semi")
    chunks = note_chunks(notes, options, embedder.max_tokens, partitions)
    if stored is None:
        return embed_column(chunks, "text", embedder, options.batch_size, partitions).drop("text")
    # The text is made again behind the join, so it holds each content once.
    held = with_stored_vectors(chunks.drop("text"), stored)
    held = held.withColumn("text", embed_text("title", "content", "chunk_index"))
    return embed_column(
        held, "text", embedder, options.batch_size, partitions, missing_only=True
    ).drop("text")


def rebuild_index(notes: DataFrame, embedder, options: Options = Options(), at=None,
                  partitions: int | None = None) -> DataFrame:
    """Index rows of every included note, for a full rebuild or another model.

    The model runs when this is called, and once: its rows are kept by a checkpoint. A
    note with a failing chunk is left out as a whole; ``index_notes`` and
    ``note_outcomes`` tell which ones fail.
    """
    included = exclude_paths(notes, options.exclude_globs)
    made = cut_lineage(index_notes(included, embedder, options, partitions=partitions))
    failed = note_outcomes(made).filter("NOT ok")
    whole = other_paths(made.filter(F.col("path").isNotNull()), failed).drop("error")
    return stamp(whole, at).select(*columns(INDEX))


def rebuild_changes(notes: DataFrame, options: Options = Options()) -> DataFrame:
    """The change set of a full rebuild."""
    return all_notes_as_changes(notes, options.exclude_globs)
