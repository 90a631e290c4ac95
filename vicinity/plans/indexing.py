"""Index maintenance, change detection and failure queries."""

from pyspark.sql import functions as F

from vicinity.operators.changes import (
    all_notes_as_changes,
    apply_exclusions,
    clear_errored,
    cleared_by_diff,
    commit_errored,
    commit_state,
    diff_counts,
    diff_snapshot,
    list_snapshot,
    note_outcomes,
    preview_exclusions,
    resolve_rename,
    retry_errored,
    reuse_embeddings,
    route_failures,
    significant_change,
)
from vicinity.operators.embedding import HashEmbedder
from vicinity.operators.index import (
    count_chunks,
    delete_notes,
    get_by_paths,
    index_notes,
    rebuild_changes,
    removed_counts,
    rename_notes,
    stamp,
    upsert_notes,
)
from vicinity.plans import base
from vicinity.plans.registry import query
from vicinity.schema import INDEX, Options, columns
from vicinity.sources.tables import read_index, write_index

_AT = "2024-03-01 00:00:00"


def _inputs(spark, sf):
    return base.notes(spark, sf), base.state(spark, sf), base.errored(spark, sf)


def _stored(spark, sf):
    return stamp(base.index(spark, sf), _AT).select(*columns(INDEX))


# --- storage --------------------------------------------------------------------------------


@query(
    "s4_s5_write_and_read_index",
    base.cte("idx")
    + """SELECT path, chunk_index, CASE WHEN number % 3 = 0 THEN 'second ' ELSE '' END || content
         AS content, sha256(path) AS path_hash FROM idx WHERE number % 5 <> 4""",
)
def s4_s5(spark, sf):
    """Store all chunks, replace some notes and drop others, read the result."""
    root = base.scratch(spark)
    index = base.index(spark, sf)
    write_index(index, root, at=_AT, buckets=8)
    again = index.filter("number % 3 = 0 AND number % 5 <> 4")
    dropped = index.filter("number % 5 = 4").select("path")
    write_index(
        again.withColumn("content", F.concat(F.lit("second "), "content")), root, dropped, at=_AT
    )
    return read_index(spark, root).select("path", "chunk_index", "content", "path_hash")


@query(
    "i1_upsert_notes",
    base.cte("idx")
    + """SELECT path, chunk_index, content FROM idx WHERE number % 3 <> 0
    UNION ALL SELECT path, chunk_index, 'new ' || content FROM idx
    WHERE number % 3 = 0 AND chunk_index < 3""",
)
def i1(spark, sf):
    index = base.index(spark, sf).select("path", "chunk_index", "content", "number")
    new = index.filter("number % 3 = 0 AND chunk_index < 3").withColumn(
        "content", F.concat(F.lit("new "), "content")
    )
    return upsert_notes(index, new).drop("number")


@query(
    "i2_delete_notes",
    base.cte("idx")
    + """SELECT path, chunk_index, content FROM idx
         WHERE path NOT IN (SELECT path FROM idx WHERE label = 3)""",
)
def i2(spark, sf):
    index = base.index(spark, sf)
    return delete_notes(index, index.filter("label = 3").select("path")).select(
        "path", "chunk_index", "content"
    )


@query(
    "i2_removed_counts",
    base.cte("idx")
    + """, asked AS (SELECT DISTINCT path FROM idx WHERE label = 3
                 UNION SELECT DISTINCT 'no/' || label || '.md' FROM idx)
    SELECT a.path, count(i.path) AS chunks, count(i.path) > 0 AS removed
    FROM asked a LEFT JOIN idx i ON i.path = a.path GROUP BY a.path""",
)
def i2_counts(spark, sf):
    index = base.index(spark, sf)
    missing = index.select(F.concat(F.lit("no/"), F.col("label").cast("string"), F.lit(".md")).alias("path"))
    return removed_counts(index, index.filter("label = 3").select("path").union(missing))


@query(
    "i3_rename_notes",
    base.cte("idx")
    + """SELECT CASE WHEN number % 4 = 1 THEN 'moved/' || path ELSE path END AS path, chunk_index,
         title, sha256(CASE WHEN number % 4 = 1 THEN 'moved/' || path ELSE path END) AS path_hash,
         CASE WHEN number % 4 = 1 THEN 'moved' ELSE 'kept' END AS outcome FROM idx
    UNION ALL SELECT DISTINCT 'moved/no' || label || '.md', NULL, NULL, NULL, 'unmatched' FROM idx""",
)
def i3(spark, sf):
    index = base.index(spark, sf)
    found = index.filter("number % 4 = 1").select("path").distinct()
    missing = index.select(
        F.concat(F.lit("no"), F.col("label").cast("string"), F.lit(".md")).alias("path")
    ).distinct()
    renames = found.unionByName(missing).select(
        F.col("path").alias("old_path"), F.concat(F.lit("moved/"), "path").alias("path")
    )
    stored = stamp(index, "2020-01-01 00:00:00").select(*columns(INDEX))
    moved, unmatched = rename_notes(stored, renames, _AT)
    fresh = F.col("last_updated") == F.lit(_AT).cast("timestamp")
    rows = moved.select(
        "path", "chunk_index", "title", "path_hash",
        F.when(fresh, "moved").otherwise("kept").alias("outcome"),
    )
    return rows.unionByName(
        unmatched.select("path", F.lit("unmatched").alias("outcome")), allowMissingColumns=True
    )


@query(
    "i4_get_by_path",
    base.cte("idx")
    + """SELECT path, chunk_index, content, len(v) AS width FROM idx
         WHERE path IN (SELECT path FROM idx WHERE label = 5)""",
)
def i4(spark, sf):
    index = base.index(spark, sf)
    asked = index.filter("label = 5").select("path")
    return get_by_paths(index, asked).select(
        "path", "chunk_index", "content", F.size("embedding").cast("bigint").alias("width")
    )


@query("i5_count_chunks", base.cte("idx") + "SELECT count(*) AS chunks FROM idx")
def i5(spark, sf):
    return count_chunks(base.index(spark, sf))


@query(
    "i6_rebuild_changes",
    base.cte("notes")
    + f"SELECT path, 'modified' AS reason, mtime FROM notes WHERE NOT {base.GLOBS_SQL}",
)
def i6(spark, sf):
    changes = rebuild_changes(base.notes(spark, sf), Options(exclude_globs=base.GLOBS))
    return changes.select("path", "reason", "mtime")


@query(
    "i7_index_notes",
    base.cte(
        "notes",
        "state",
        "errored",
        more={
            "todo": """SELECT n.path, n.title, n.content FROM notes n
                LEFT JOIN state s ON s.path = n.path LEFT JOIN errored e ON e.path = n.path
                WHERE (s.path IS NULL AND (e.path IS NULL OR e.mtime <> n.mtime))
                   OR s.mtime <> n.mtime""",
            "src": r"""SELECT path, title, regexp_replace(content, '[0-9]+', '', 'g') AS content
                FROM todo""",
            **base.chunk_ctes(512),
            "texts": """SELECT path, chunk_index, total_chunks,
                CASE WHEN chunk_index = 0 THEN title || chr(10) || chr(10) ELSE '' END || content
                AS text FROM chunks""",
            **base.vector_ctes("texts", "path, chunk_index", "text", 64),
        },
        recursive=True,
    )
    + """SELECT t.path, t.chunk_index, t.total_chunks,
         CAST(len(list_filter(v.v, lambda x: x > 0)) AS INTEGER) AS used,
         round(list_sum(CAST(v.v AS DOUBLE[])), 4) AS weight
    FROM texts t JOIN vectors v USING (path, chunk_index)""",
)
def i7(spark, sf):
    """From a snapshot diff to vectors, as one plan."""
    notes, state, errored = _inputs(spark, sf)
    options = Options(exclude_regexes=("[0-9]+",), exclude_globs=())
    made = index_notes(
        notes, HashEmbedder(64), options, diff_snapshot(notes, state, errored),
        partitions=int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    values = F.col("embedding").cast("array<double>")
    return made.filter("error IS NULL").select(
        "path", "chunk_index", "total_chunks",
        F.size(F.filter(values, lambda x: x > 0)).alias("used"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("weight"),
    )


# --- change detection ---------------------------------------------------------------------------


@query(
    "s2_list_snapshot",
    "SELECT url || '.md' AS path, page_id AS mtime FROM pages WHERE page_id % 3 <> 0",
)
def s2(spark, sf):
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit(".md")))
    pages = base.table(spark, sf, "pages").select(name.alias("path"), F.col("page_id").alias("mtime"))
    return list_snapshot(pages)


_DIFF = {
    "kept": f"SELECT path, mtime FROM notes WHERE NOT {base.GLOBS_SQL}",
    "diff": """
        SELECT k.path, 'new' AS reason, k.mtime FROM kept k
        LEFT JOIN errored e ON e.path = k.path
        WHERE k.path NOT IN (SELECT path FROM state) AND (e.path IS NULL OR e.mtime <> k.mtime)
        UNION ALL SELECT k.path, 'modified', k.mtime FROM kept k JOIN state s USING (path)
        WHERE s.mtime <> k.mtime
        UNION ALL SELECT path, 'deleted', NULL FROM state
        WHERE path NOT IN (SELECT path FROM kept)""",
}
_DIFF_SQL = base.cte("state", "errored", more=_DIFF)


@query("d1_diff_snapshot", _DIFF_SQL + "SELECT * FROM diff")
def d1(spark, sf):
    changes = diff_snapshot(*_inputs(spark, sf), base.GLOBS)
    return changes.select("path", "reason", "mtime")


@query(
    "d1_diff_counts",
    _DIFF_SQL
    + """SELECT count(*) FILTER (reason = 'new') AS added, count(*) FILTER (reason = 'deleted')
         AS removed, count(*) FILTER (reason = 'modified') AS updated FROM diff""",
)
def d1_counts(spark, sf):
    return diff_counts(diff_snapshot(*_inputs(spark, sf), base.GLOBS))


@query(
    "d2_skip_errored",
    _DIFF_SQL
    + """SELECT e.path, e.mtime FROM errored e JOIN kept k USING (path)
         WHERE e.mtime <> k.mtime AND e.path NOT IN (SELECT path FROM state)""",
)
def d2(spark, sf):
    return cleared_by_diff(*_inputs(spark, sf), base.GLOBS).select("path", "mtime")


@query(
    "d3_apply_exclusions",
    _DIFF_SQL + "SELECT * FROM diff WHERE reason <> 'modified'",
)
def d3(spark, sf):
    return apply_exclusions(*_inputs(spark, sf), base.GLOBS).select("path", "reason", "mtime")


@query(
    "d3_preview_exclusions",
    _DIFF_SQL
    + """SELECT count(*) FILTER (reason = 'deleted') AS removed,
         count(*) FILTER (reason = 'new') AS added FROM diff""",
)
def d3_preview(spark, sf):
    return preview_exclusions(*_inputs(spark, sf), base.GLOBS)


@query(
    "d4_all_notes_as_changes",
    base.cte("notes", more=_DIFF | {"diff": "SELECT 1"})
    + "SELECT path, 'modified' AS reason, mtime FROM kept",
)
def d4(spark, sf):
    return all_notes_as_changes(base.notes(spark, sf), base.GLOBS).select("path", "reason", "mtime")


@query(
    "d5_retry_errored",
    base.cte("errored")
    + """SELECT path, 'modified' AS reason, n.mtime FROM errored e JOIN notes n USING (path)""",
)
def d5(spark, sf):
    notes, _, errored = _inputs(spark, sf)
    return retry_errored(errored, notes).select("path", "reason", "mtime")


_RENAMES = """SELECT path AS old_path, CASE doc_id % 3 WHEN 0 THEN 'Archive/' || title || '.md'
    ELSE 'moved/' || path END AS path, mtime FROM notes"""


def _renames(spark, sf):
    target = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("Archive/"), "title", F.lit(".md"))
    ).otherwise(F.concat(F.lit("moved/"), "path"))
    return base.notes(spark, sf).select(
        F.col("path").alias("old_path"), target.alias("path"), "mtime"
    )


_RESOLVED = {
    "renames": _RENAMES,
    "seen": """SELECT r.*, s.mtime = r.mtime AS same FROM renames r
        LEFT JOIN state s ON s.path = r.old_path""",
    "resolved": """
        SELECT old_path AS path, 'deleted' AS reason, CAST(NULL AS BIGINT) AS mtime,
               CAST(NULL AS VARCHAR) AS old_path
        FROM seen WHERE path LIKE 'Archive/%' OR NOT coalesce(same, false)
        UNION ALL SELECT path, 'renamed', mtime, old_path FROM seen
        WHERE path NOT LIKE 'Archive/%' AND same
        UNION ALL SELECT path, 'new', mtime, NULL FROM seen
        WHERE path NOT LIKE 'Archive/%' AND NOT coalesce(same, false)""",
}


@query("d6_resolve_rename", base.cte("state", more=_RESOLVED) + "SELECT * FROM resolved")
def d6(spark, sf):
    changes = resolve_rename(_renames(spark, sf), base.state(spark, sf), ("Archive/",))
    return changes.select("path", "reason", "mtime", "old_path")


@query(
    "d7_commit_state",
    base.cte("state", more=_RESOLVED)
    + """SELECT path, mtime FROM state WHERE path NOT IN (SELECT old_path FROM renames)
    UNION ALL SELECT path, mtime FROM resolved WHERE reason <> 'deleted' AND mtime <> 0""",
)
def d7(spark, sf):
    state = base.state(spark, sf)
    return commit_state(state, resolve_rename(_renames(spark, sf), state, ("Archive/",)))


@query(
    "d7_commit_errored",
    base.cte("state", "errored", more=_RESOLVED)
    + "SELECT path, attempts FROM errored WHERE path NOT IN (SELECT path FROM resolved)",
)
def d7_errored(spark, sf):
    done = resolve_rename(_renames(spark, sf), base.state(spark, sf), ("Archive/",))
    return commit_errored(base.errored(spark, sf), done).select("path", "attempts")


# --- failures ---------------------------------------------------------------------------------------


@query(
    "r1_route_failures",
    """SELECT 'note' || event_id || '.md' AS path, CAST(event_id % 4 + 1 AS INTEGER) AS attempts,
       CASE WHEN event_id % 4 + 1 < 3 THEN 'retry' ELSE 'dead' END AS outcome,
       CASE WHEN event_id % 4 + 1 < 3 THEN NULL ELSE 'failed for ' || user_id END AS error
    FROM events WHERE event_type = 'error'""",
)
def r1(spark, sf):
    outcomes = base.table(spark, sf, "events").select(
        F.concat(F.lit("note"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("modified").alias("reason"),
        F.col("event_id").alias("mtime"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("failed for "), F.col("user_id").cast("string")),
        ).alias("error"),
    )
    again, dead = route_failures(outcomes, at=_AT)
    return again.select("path", "attempts", F.lit("retry").alias("outcome")).unionByName(
        dead.select("path", "attempts", F.lit("dead").alias("outcome"), "error"),
        allowMissingColumns=True,
    )


@query(
    "r2_note_outcomes",
    base.cte("talks")
    + """SELECT path, bool_and(length(content) % 50 <> 0) AS ok,
         max(CASE WHEN length(content) % 50 = 0 THEN 'bad chunk' END) AS error
    FROM talks GROUP BY path""",
)
def r2(spark, sf):
    bad = F.when(F.length("content") % 50 == 0, "bad chunk")
    return note_outcomes(base.talks(spark, sf).withColumn("error", bad))


@query(
    "r3_clear_errored",
    base.cte("errored")
    + "SELECT path, attempts FROM errored WHERE path NOT IN (SELECT path FROM notes WHERE doc_id % 2 = 0)",
)
def r3(spark, sf):
    notes, _, errored = _inputs(spark, sf)
    reason = F.when(F.col("doc_id") % 2 == 1, "deleted").when(
        F.col("doc_id") % 4 == 0, "new"
    ).otherwise("modified")
    return clear_errored(errored, notes.withColumn("reason", reason)).select("path", "attempts")


# --- options -------------------------------------------------------------------------------------------


@query(
    "x1_reuse_embeddings",
    base.cte("idx")
    + """SELECT path, chunk_index, NOT (vec_id % 6 = 0 OR (chunk_index = 0 AND number % 3 = 0))
         AS reused FROM idx""",
)
def x1(spark, sf):
    """Every sixth chunk has other content, every third note another title."""
    index = base.index(spark, sf)
    edited = index.select(
        "path",
        F.when(F.col("number") % 3 == 0, F.concat(F.lit("re: "), "title")).otherwise(
            F.col("title")).alias("title"),
        F.when(F.col("vec_id") % 6 == 0, F.concat(F.lit("edited "), "content")).otherwise(
            F.col("content")).alias("content"),
        "chunk_index",
    )
    reused, rest = reuse_embeddings(edited, index)
    return reused.select("path", "chunk_index", F.lit(True).alias("reused")).unionByName(
        rest.select("path", "chunk_index", F.lit(False).alias("reused"))
    )


@query(
    "x2_significant_change",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false
        WHEN 1 THEN 12.0 / greatest(length(text), 1) >= 0.02
        WHEN 2 THEN false ELSE true END AS significant FROM documents""",
)
def x2(spark, sf):
    """White space added, a short addition, one character swapped, the text doubled."""
    new = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n")), F.lit("\n")))
        .when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" more words.")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("~"), F.expr("substring(text, 2)")))
        .otherwise(F.concat("text", F.lit(" "), "text"))
    )
    return base.table(spark, sf, "documents").select(
        "doc_id", significant_change(F.col("text"), new).alias("significant")
    )
