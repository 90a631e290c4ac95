"""Related notes for a corpus, search by text, and the steps that shape results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.text import embed_text, link_text, min_query_length
from vicinity.functions.tokens import check_token_limit, truncate_to_tokens
from vicinity.lineage import cut_lineage
from vicinity.operators.chunking import chunk_notes
from vicinity.operators.embedding import embed_column
from vicinity.operators.knn import knn_chunks
from vicinity.schema import (
    CHUNK_OVERLAP,
    CHUNKS_PER_SOURCE_CHUNK,
    MIN_SEARCH_CHARS,
    MIN_SUGGEST_CHARS,
    SEMANTIC_CHUNK_TOKENS,
    TEXT_SEARCH_FACTOR,
    Options,
)


# --- steps on result rows -------------------------------------------------------------


def exclude_self(hits: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Drop hits on the source itself, or those listed in ``(source_path, path)``."""
    if exclusions is None:
        return hits.filter(F.col("path") != F.col("source_path"))
    return hits.join(exclusions, ["source_path", "path"], "left_anti")


def flag_linked(results: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``is_linked``: the source note already links to the target."""
    known = links.select(
        F.col("src").alias("source_path"), F.col("dst").alias("path")
    ).distinct().withColumn("is_linked", F.lit(True))
    return results.drop("is_linked").join(known, ["source_path", "path"], "left").withColumn(
        "is_linked", F.coalesce("is_linked", F.lit(False))
    )


def min_similarity(results: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Display threshold, applied to ranked results and inclusive."""
    return results.filter(F.col("similarity") >= threshold)


def drop_stale(results: DataFrame, notes: DataFrame) -> DataFrame:
    """Results whose note still exists. Nothing moves up to fill the gap."""
    return results.join(notes.select("path"), "path", "left_semi")


def stale_results(results: DataFrame, notes: DataFrame) -> DataFrame:
    """The rows ``drop_stale`` removes."""
    return results.join(notes.select("path"), "path", "left_anti")


def source_chunk_toggle(results: DataFrame, keep: bool) -> DataFrame:
    """Source chunk text as it is, or absent."""
    return results.withColumn("source_chunk", F.when(F.lit(keep), F.col("source_chunk")))


def display_name(results: DataFrame, mode: str = "smart") -> DataFrame:
    """Adds ``display_name``. ``smart`` shows the path only where two rows of one result
    list share a file name."""
    if mode == "path":
        return results.withColumn("display_name", F.col("path"))
    if mode != "smart":
        return results.withColumn("display_name", F.col("title"))
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    same = Window.partitionBy("source_path", "_name")
    return (
        results.withColumn("_name", name)
        .withColumn(
            "display_name",
            F.when(
                F.count("*").over(same) > 1, F.regexp_replace("path", r"\.md\z", "")
            ).otherwise(F.col("title")),
        )
        .drop("_name")
    )


# --- related notes ----------------------------------------------------------------------


def best_pairs(hits: DataFrame) -> DataFrame:
    """Best chunk pair per source and target note.

    Equal scores go to the earlier source chunk, then the earlier target chunk. An
    aggregate over a struct, so it is combined before the shuffle.
    """
    best = F.min(
        F.struct((-F.col("score")).alias("cost"), "source_chunk_index", "chunk_index")
    )
    return (
        hits.groupBy("source_path", "path")
        .agg(best.alias("best"))
        .select(
            "source_path",
            "path",
            (-F.col("best.cost")).alias("similarity"),
            F.col("best.source_chunk_index").alias("source_chunk_index"),
            F.col("best.chunk_index").alias("chunk_index"),
        )
    )


def rank_targets(best: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` targets of each source by similarity, ties by path."""
    order = Window.partitionBy("source_path").orderBy(F.desc("similarity"), "path")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fresh_chunks(
    notes: DataFrame,
    index: DataFrame,
    embedder,
    chunk_size: int = SEMANTIC_CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
    counter="bytes",
) -> DataFrame:
    """Chunks with vectors of notes the index does not hold.

    Content is taken as given: deletion patterns belong to indexing only. A note with a
    failing chunk yields nothing.
    """
    unknown = notes.filter(F.col("content") != "").join(
        index.select("path"), "path", "left_anti"
    )
    chunks = chunk_notes(unknown, chunk_size, overlap, counter)
    chunks = chunks.withColumn("text", embed_text("title", "content", "chunk_index"))
    # Used twice here and again by the search: the model must run once.
    made = cut_lineage(embed_column(chunks, "text", embedder).drop("text"))
    failed = made.filter(F.col("error").isNotNull()).select("path").distinct()
    return made.join(failed, "path", "left_anti").drop("error")


def related_notes(
    index: DataFrame,
    sources: DataFrame | None = None,
    limit: int = 5,
    k: int = CHUNKS_PER_SOURCE_CHUNK,
    links: DataFrame | None = None,
    fresh: DataFrame | None = None,
    plan: str = "auto",
    texts: bool = True,
) -> DataFrame:
    """Most related notes of every source note.

    Each source chunk takes its ``k`` best chunks of other notes; the pairs are pooled
    to the best one per target; the first ``limit`` targets remain. ``sources`` has a
    ``path`` column and defaults to the whole index. ``fresh`` adds chunks of notes that
    are asked about without being indexed (see ``fresh_chunks``).

    Only keys and vectors go through the search; titles and texts are joined to the
    survivors.
    """
    asked = index
    if fresh is not None:
        columns = ["path", "chunk_index", "embedding"] + (["content"] if texts else [])
        asked = index.select(*columns).unionByName(fresh.select(*columns))
    if sources is not None:
        asked = asked.join(sources.select("path").distinct(), "path", "left_semi")
    queries = asked.select(
        F.col("path").alias("source_path"),
        F.col("chunk_index").alias("source_chunk_index"),
        F.col("path").alias("exclude_path"),
        "embedding",
    )
    hits = knn_chunks(queries, index, k, plan=plan)
    results = rank_targets(best_pairs(hits), limit)
    if texts:
        results = with_texts(results, index, asked)
    if links is not None:
        results = flag_linked(results, links)
    return results


def with_texts(results: DataFrame, index: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds title, target chunk text and source chunk text to ranked rows."""
    target = index.select(
        "path", "chunk_index", "title", F.col("content").alias("similar_chunk")
    )
    source = sources.select(
        F.col("path").alias("source_path"),
        F.col("chunk_index").alias("source_chunk_index"),
        F.col("content").alias("source_chunk"),
    )
    return results.join(target, ["path", "chunk_index"]).join(
        source, ["source_path", "source_chunk_index"]
    )


def recommend(
    index: DataFrame,
    notes: DataFrame,
    links: DataFrame,
    options: Options = Options(),
    sources: DataFrame | None = None,
    plan: str = "auto",
) -> DataFrame:
    """Related notes as every view needs them: the larger count, stale rows dropped."""
    found = related_notes(
        index, sources, limit=options.result_count, links=links, plan=plan
    )
    return source_chunk_toggle(drop_stale(found, notes), options.show_source_chunk)


def view_slice(results: DataFrame, view: str = "sidebar", options: Options = Options()) -> DataFrame:
    """Threshold, then the first rows of each source that the view shows."""
    count = {"sidebar": options.sidebar_count, "bottom": options.bottom_count}[view]
    shown = Window.partitionBy("source_path").orderBy("rank")
    return (
        min_similarity(results, options.min_similarity)
        .withColumn("position", F.row_number().over(shown))
        .filter(F.col("position") <= count)
    )


# --- search by text -----------------------------------------------------------------------


def query_vectors(queries: DataFrame, embedder, counter="bytes") -> DataFrame:
    """Token check, cut and vectors of a table of ``query_id, text``.

    ``text`` stays whole; only the text given to the model is cut.
    """
    checked = check_token_limit(queries, embedder.max_tokens, counter)
    cut = truncate_to_tokens("text", embedder.max_tokens, counter)
    return embed_column(checked.withColumn("_cut", cut), "_cut", embedder).drop("_cut")


def search_text(
    queries: DataFrame,
    index: DataFrame,
    embedder=None,
    limit: int = 10,
    counter="bytes",
    plan: str = "auto",
    texts: bool = True,
) -> DataFrame:
    """Notes that match each query text, best chunk per note.

    ``queries`` has ``query_id`` and ``text``; without an ``embedder`` it must carry
    ``embedding`` as well. Queries that fail to embed return nothing.
    """
    asked = queries
    if embedder is not None:
        asked = query_vectors(queries, embedder, counter).filter(F.col("error").isNull())
        # The search looks at the queries' number first: the model must run once.
        asked = cut_lineage(asked.select("query_id", "embedding"))
        queries = check_token_limit(queries, embedder.max_tokens, counter)
    hits = knn_chunks(
        asked.select("query_id", "embedding"), index, TEXT_SEARCH_FACTOR * limit, plan=plan
    )
    best = F.min(F.struct((-F.col("score")).alias("cost"), "chunk_index"))
    per_note = (
        hits.groupBy("query_id", "path")
        .agg(best.alias("best"))
        .select(
            "query_id",
            "path",
            (-F.col("best.cost")).alias("similarity"),
            F.col("best.chunk_index").alias("chunk_index"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path")
    ranked = per_note.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= limit
    )
    if not texts:
        return ranked
    target = index.select(
        "path", "chunk_index", "title", F.col("content").alias("similar_chunk")
    )
    carried = [c for c in ("token_count", "max_tokens", "is_over_limit") if c in queries.columns]
    source = queries.select("query_id", F.col("text").alias("source_chunk"), *carried)
    return ranked.join(target, ["path", "chunk_index"]).join(source, "query_id")


def search_queries(queries: DataFrame) -> DataFrame:
    """Texts long enough for the search box."""
    return min_query_length(queries, MIN_SEARCH_CHARS)


def suggest_links(
    queries: DataFrame,
    index: DataFrame,
    notes: DataFrame,
    embedder=None,
    limit: int = 10,
    counter="bytes",
    plan: str = "auto",
) -> DataFrame:
    """Link texts for each query; notes that no longer exist are left out.

    A link names the title if no other note has it, or else the path.
    """
    found = search_text(
        min_query_length(queries, MIN_SUGGEST_CHARS), index, embedder, limit, counter,
        plan, texts=False,
    )
    named = notes.select("path", "title").distinct()
    shared = named.groupBy("title").count().filter("count > 1").select("title")
    shared = shared.withColumn("shared", F.lit(True))
    target = F.when(F.col("shared"), F.regexp_replace("path", r"\.md$", "")).otherwise(F.col("title"))
    return (
        found.join(named, "path")
        .join(shared, "title", "left")
        .withColumn("link", link_text(target))
        .drop("shared")
    )
