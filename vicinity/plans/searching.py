"""Similarity search queries."""

from pyspark.sql import functions as F

from vicinity.functions.text import embed_text
from vicinity.operators.chunking import chunk_notes
from vicinity.operators.embedding import HashEmbedder, embed_column
from vicinity.operators.knn import knn_chunks
from vicinity.operators.search import (
    display_name,
    drop_stale,
    exclude_self,
    flag_linked,
    fresh_chunks,
    min_similarity,
    recommend,
    related_notes,
    search_queries,
    search_text,
    source_chunk_toggle,
    stale_results,
    suggest_links,
    view_slice,
)
from vicinity.plans import base
from vicinity.plans.registry import query
from vicinity.schema import Options
from vicinity.sources.tables import read_index, write_index

_CORE = "source_path, source_chunk_index, path, chunk_index"
_ROUND = "round(similarity, 6) AS similarity"


def _queries(index):
    return index.select(
        F.col("path").alias("source_path"),
        F.col("chunk_index").alias("source_chunk_index"),
        F.col("path").alias("exclude_path"),
        "embedding",
    )


def _rounded(df, col="similarity"):
    return df.withColumn(col, F.round(col, 6))


_HITS = base.cte("hits") + (
    f"SELECT {_CORE}, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits"
)


@query("q1_knn_chunks", _HITS)
def q1(spark, sf):
    index = base.index(spark, sf)
    return _rounded(knn_chunks(_queries(index), index, 15), "score")


@query("q1_knn_chunks_cells", _HITS)
def q1_cells(spark, sf):
    """The plan for more queries than can be broadcast."""
    index = base.index(spark, sf)
    hits = knn_chunks(_queries(index), index, 15, plan="cells", cell_rows=100)
    return _rounded(hits, "score")


@query("q1_knn_chunks_bounds", _HITS)
def q1_bounds(spark, sf):
    """Compressed vectors first, then the few pairs their bounds leave."""
    index = base.index(spark, sf)
    return _rounded(knn_chunks(_queries(index), index, 15, plan="bounds"), "score")


@query(
    "q1_knn_chunks_excluding",
    base.cte("idx")
    + f""", s AS (SELECT a.vec_id AS query_id, b.path, b.chunk_index,
                 round(list_cosine_similarity(a.v, b.v), 12) AS score
          FROM idx a JOIN idx b ON b.path NOT IN (a.path,
              {base.note_path_sql("(a.number + 1)")}, {base.note_path_sql("(a.number + 2)")}))
    SELECT query_id, path, chunk_index, round(score, 6) AS score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_index)
                AS INTEGER) AS rank
    FROM s WHERE score >= 0.1 QUALIFY rank <= 5""",
)
def q1_excluding(spark, sf):
    """Several excluded paths per query, and a minimum score."""
    index = base.index(spark, sf)
    passed_over = F.array(
        F.col("path"), base.note_path(F.col("number") + 1), base.note_path(F.col("number") + 2)
    )
    queries = index.select(
        F.col("vec_id").alias("query_id"), passed_over.alias("exclude_paths"), "embedding"
    )
    return _rounded(knn_chunks(queries, index, 5, min_score=0.1), "score")


@query(
    "q2_related_notes",
    base.cte("related")
    + f"""SELECT {_CORE}, {_ROUND}, rank, title, similar_chunk, source_chunk, is_linked
    FROM related WHERE rank <= 5""",
)
def q2(spark, sf):
    found = related_notes(base.index(spark, sf), links=base.links(spark, sf))
    return _rounded(found)


@query(
    "q2_related_notes_cells",
    base.cte("ranked")
    + f"SELECT {_CORE}, {_ROUND}, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
)
def q2_cells(spark, sf):
    return _rounded(related_notes(base.index(spark, sf), plan="cells", texts=False))


@query(
    "q2_related_notes_bounds",
    base.cte("ranked")
    + f"SELECT {_CORE}, {_ROUND}, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
)
def q2_bounds(spark, sf):
    return _rounded(related_notes(base.index(spark, sf), plan="bounds", texts=False))


@query(
    "p8_exclude_self",
    base.cte("idx")
    + """, h AS (SELECT s.path AS source_path, s.chunk_index AS source_chunk_index, t.path,
                 t.chunk_index, round(list_cosine_similarity(s.v, t.v), 12) AS score
          FROM idx s, idx t),
    top AS (SELECT * FROM h WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY
             source_path, source_chunk_index ORDER BY score DESC, path, chunk_index) <= 5)
    SELECT source_path, source_chunk_index, path, chunk_index, round(score, 6) AS score
    FROM top WHERE path <> source_path""",
)
def p8(spark, sf):
    index = base.index(spark, sf)
    hits = knn_chunks(_queries(index).drop("exclude_path"), index, 5)
    return _rounded(exclude_self(hits), "score").drop("rank")


def _related(spark, sf, limit=10):
    return related_notes(base.index(spark, sf), limit=limit, texts=False)


@query(
    "p9_flag_linked",
    base.cte("ranked", "links")
    + """SELECT source_path, path, CAST(rank AS INTEGER) AS rank, dst IS NOT NULL AS is_linked
    FROM ranked LEFT JOIN links ON src = source_path AND dst = path""",
)
def p9(spark, sf):
    flagged = flag_linked(_related(spark, sf), base.links(spark, sf))
    return flagged.select("source_path", "path", "rank", "is_linked")


@query(
    "p10_min_similarity",
    base.cte("ranked")
    + f"SELECT source_path, path, {_ROUND}, CAST(rank AS INTEGER) AS rank FROM ranked "
    "WHERE similarity >= 0.3",
)
def p10(spark, sf):
    kept = min_similarity(_related(spark, sf), 0.3)
    return _rounded(kept.select("source_path", "path", "similarity", "rank"))


@query(
    "p11_drop_stale",
    base.cte("ranked", "live")
    + """SELECT source_path, path, CAST(rank AS INTEGER) AS rank,
         path NOT IN (SELECT path FROM live) AS stale FROM ranked""",
)
def p11(spark, sf):
    found, live = _related(spark, sf), base.live_notes(spark, sf)
    kept = drop_stale(found, live).withColumn("stale", F.lit(False))
    gone = stale_results(found, live).withColumn("stale", F.lit(True))
    return kept.unionByName(gone).select("source_path", "path", "rank", "stale")


@query(
    "p12_source_chunk_toggle",
    base.cte("related")
    + """SELECT source_path, path, 'kept' AS setting, source_chunk FROM related WHERE rank <= 5
    UNION ALL SELECT source_path, path, 'hidden', NULL FROM related WHERE rank <= 5""",
)
def p12(spark, sf):
    found = related_notes(base.index(spark, sf))
    parts = [
        source_chunk_toggle(found, keep).select(
            "source_path", "path", F.lit(name).alias("setting"), "source_chunk"
        )
        for keep, name in ((True, "kept"), (False, "hidden"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "p13_display_name",
    base.cte("related")
    + """SELECT source_path, path, title AS by_title, path AS by_path,
         CASE WHEN count(*) OVER (PARTITION BY source_path, split_part(path, '/', 2)) > 1
              THEN left(path, length(path) - 3) ELSE title END AS smart FROM related""",
)
def p13(spark, sf):
    found = related_notes(base.index(spark, sf), limit=10)
    named = display_name(found, "title").withColumnRenamed("display_name", "by_title")
    named = display_name(named, "path").withColumnRenamed("display_name", "by_path")
    return display_name(named, "smart").select(
        "source_path", "path", "by_title", "by_path", F.col("display_name").alias("smart")
    )


# --- notes asked about without being indexed ------------------------------------------------

_DIM = 64


def _made_ctes(source: str, size: int) -> dict[str, str]:
    """Chunks of ``source`` with vectors of their embedded texts, as ``made``."""
    return {
        "src": source,
        **base.chunk_ctes(size),
        "texts": """SELECT path, chunk_index, title, content,
            CASE WHEN chunk_index = 0 THEN title || chr(10) || chr(10) ELSE '' END || content
            AS text FROM chunks""",
        **base.vector_ctes("texts", "path, chunk_index", "text", _DIM),
        "made": """SELECT t.path, t.chunk_index, t.title, t.content,
            CAST(v.v AS DOUBLE[]) AS v FROM texts t JOIN vectors v USING (path, chunk_index)""",
    }


def _stored(notes, size):
    """The same as an index on disk, as a user has it; the model runs once."""
    root = base.scratch(notes.sparkSession)
    write_index(_made(notes, size), root)
    return read_index(notes.sparkSession, root)


def _made(notes, size):
    chunks = chunk_notes(notes, size)
    chunks = chunks.withColumn("text", embed_text("title", "content", "chunk_index"))
    return embed_column(chunks, "text", HashEmbedder(_DIM)).drop("text", "error")


@query(
    "q3_related_notes_fresh",
    base.cte(
        "turns",
        more={
            **_made_ctes("SELECT path, title, content FROM turns", 256),
            "h": """SELECT s.path AS source_path, s.chunk_index AS source_chunk_index, t.path,
                t.chunk_index, round(list_cosine_similarity(s.v, t.v), 12) AS score
                FROM made s JOIN made t ON s.path <> t.path
                WHERE s.path LIKE 'user/%' AND t.path NOT LIKE 'user/%'""",
            "top": """SELECT * FROM h WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY
                source_path, source_chunk_index ORDER BY score DESC, path, chunk_index) <= 15""",
            "pooled": """SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY source_path, path
                ORDER BY score DESC, source_chunk_index, chunk_index) = 1""",
        },
        recursive=True,
    )
    + """SELECT source_path, path, round(score, 5) AS similarity, CAST(row_number() OVER (
         PARTITION BY source_path ORDER BY score DESC, path) AS INTEGER) AS rank
    FROM pooled QUALIFY rank <= 5""",
)
def q3(spark, sf):
    """Turns of users are not indexed; the other turns are, and stored."""
    turns = base.turns(spark, sf)
    index = _stored(turns.filter("role <> 'user'"), 256)
    fresh = fresh_chunks(turns, index, HashEmbedder(_DIM), 256)
    found = related_notes(index, sources=fresh, fresh=fresh, texts=False)
    return found.select(
        "source_path", "path", F.round("similarity", 5).alias("similarity"), "rank"
    )


@query(
    "q4_search_text",
    base.cte(
        "turns",
        more={
            **_made_ctes("SELECT path, title, content FROM turns WHERE role <> 'user'", 256),
            "asked": """SELECT title AS query_id, content AS text,
                CAST((octet_length(encode(content)) + 1) // 2 AS INTEGER) AS token_count
                FROM turns WHERE role = 'user'""",
            "cut0": """SELECT query_id, text, token_count, unnest(range(20, 129)) AS n FROM asked""",
            "cuts": """SELECT query_id, max(n) AS n FROM cut0
                WHERE octet_length(encode(left(text, CAST(n AS INTEGER)))) <= 128
                GROUP BY query_id""",
            "cut": """SELECT query_id, text AS whole, token_count, CASE WHEN token_count <= 64
                THEN text ELSE left(text, CAST(n AS INTEGER)) END AS text
                FROM asked LEFT JOIN cuts USING (query_id)""",
            **base.vector_ctes("cut", "query_id", "text", _DIM, "asking"),
            "h": """SELECT q.query_id, m.path, m.chunk_index,
                round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), m.v), 12) AS score
                FROM asking q, made m""",
            "top": """SELECT * FROM h WHERE score >= 0 QUALIFY row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, path, chunk_index) <= 30""",
            "pooled": """SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id, path
                ORDER BY score DESC, chunk_index) = 1""",
            "final": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY score DESC, path) AS INTEGER) AS rank FROM pooled QUALIFY rank <= 10""",
        },
        recursive=True,
    )
    + """SELECT f.query_id, f.path, f.chunk_index, round(f.score, 5) AS similarity, f.rank,
         m.title, m.content AS similar_chunk, c.whole AS source_chunk, c.token_count,
         64 AS max_tokens, c.token_count > 64 AS is_over_limit
    FROM final f JOIN made m USING (path, chunk_index) JOIN cut c USING (query_id)""",
)
def q4(spark, sf):
    """Turns of users as queries against the stored index of the other turns; long queries
    are cut."""
    turns = base.turns(spark, sf)
    index = _stored(turns.filter("role <> 'user'"), 256)
    queries = turns.filter("role = 'user'").select(
        F.col("title").alias("query_id"), F.col("content").alias("text")
    )
    found = search_text(queries, index, HashEmbedder(_DIM, max_tokens=64))
    return found.withColumn("similarity", F.round("similarity", 5))


_GIVEN = base.cte(
    "idx",
    more={
        "h": """SELECT a.vec_id AS query_id, b.path, b.chunk_index,
            round(list_cosine_similarity(a.v, b.v), 12) AS score FROM idx a, idx b""",
        "top": """SELECT * FROM h WHERE score >= 0 QUALIFY row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, path, chunk_index) <= 30""",
        "pooled": """SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id, path
            ORDER BY score DESC, chunk_index) = 1""",
        "final": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, path) AS INTEGER) AS rank FROM pooled QUALIFY rank <= 10""",
    },
)


def _vector_queries(index):
    return index.select(F.col("vec_id").alias("query_id"), F.col("content").alias("text"), "embedding")


@query(
    "q4_search_vectors",
    _GIVEN + "SELECT query_id, path, chunk_index, round(score, 6) AS similarity, rank FROM final",
)
def q4_vectors(spark, sf):
    index = base.index(spark, sf)
    return _rounded(search_text(_vector_queries(index), index, texts=False))


@query(
    "q5_recommend",
    base.cte("related", "live")
    + f"""SELECT {_CORE}, {_ROUND}, rank, title, similar_chunk,
         CAST(NULL AS VARCHAR) AS source_chunk, is_linked
    FROM related WHERE path IN (SELECT path FROM live)""",
)
def q5(spark, sf):
    found = recommend(base.index(spark, sf), base.live_notes(spark, sf), base.links(spark, sf))
    return _rounded(found)


@query(
    "q6_view_slice",
    base.cte("related", "live")
    + """, shown AS (SELECT source_path, path, rank, row_number() OVER (
             PARTITION BY source_path ORDER BY rank) AS position
         FROM related WHERE path IN (SELECT path FROM live) AND similarity >= 0.25)
    SELECT 'sidebar' AS view, source_path, path, CAST(position AS INTEGER) AS position
    FROM shown WHERE position <= 10
    UNION ALL SELECT 'bottom', source_path, path, CAST(position AS INTEGER)
    FROM shown WHERE position <= 5""",
)
def q6(spark, sf):
    options = Options(min_similarity=0.25)
    found = drop_stale(_related(spark, sf, options.result_count), base.live_notes(spark, sf))
    parts = [
        view_slice(found, view, options).select(
            F.lit(view).alias("view"), "source_path", "path", "position"
        )
        for view in ("sidebar", "bottom")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "q7_suggest_links",
    _GIVEN.rstrip()
    + """,\nlive AS (SELECT DISTINCT path, title FROM idx WHERE number % 6 <> 0),
    named AS (SELECT path, CASE WHEN path LIKE 'f0/%' THEN path ELSE title END AS title FROM live)\n"""
    + """SELECT query_id, path, rank, '[[' || CASE WHEN n > 1 THEN regexp_replace(path, '\\.md$', '')
        ELSE title END || ']]' AS link
    FROM final JOIN (SELECT *, count(*) OVER (PARTITION BY title) AS n FROM named) USING (path)""",
)
def q7(spark, sf):
    index = base.index(spark, sf)
    queries = search_queries(_vector_queries(index))
    # Titles of one folder are their own; all others are shared by several notes.
    title = F.when(F.col("path").startswith("f0/"), F.col("path")).otherwise(F.col("title"))
    notes = base.live_notes(spark, sf).withColumn("title", title)
    return suggest_links(queries, index, notes).select(
        "query_id", "path", "rank", "link"
    )
