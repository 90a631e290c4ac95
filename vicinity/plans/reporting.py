"""Source, state, report, usage and export queries."""

from pyspark.sql import functions as F

from vicinity.functions.globs import is_excluded
from vicinity.operators.reports import (
    estimate_usage,
    index_counts,
    index_status,
    note_status,
    preview_list,
    usage_cost,
    usage_daily,
    usage_retention,
    usage_today,
    usage_total,
    visible_errored,
)
from vicinity.operators.search import related_notes
from vicinity.operators.state import count_state, drop_state, get_state, set_errored, set_state
from vicinity.plans import base
from vicinity.plans.registry import query
from vicinity.sources.export import export_related
from vicinity.sources.notes import append_usage, find_notes, read_links, read_usage


@query(
    "s1_find_notes",
    base.cte("notes")
    + """, asked AS (SELECT source || '/' || lang || '/' || (doc_id * 2) || '.md' AS path
                 FROM documents)
    SELECT DISTINCT a.path, n.title, n.mtime FROM asked a LEFT JOIN notes n ON n.path = a.path""",
)
def s1(spark, sf):
    notes = base.notes(spark, sf)
    asked = base.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"),
                 (F.col("doc_id") * 2).cast("string"), F.lit(".md")).alias("path")
    )
    return find_notes(notes, asked).select("path", "title", "mtime")


@query(
    "s3_read_links_html",
    """SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst
    FROM pages""",
)
def s3_html(spark, sf):
    pages = base.table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return read_links(pages, "html")


@query(
    "s3_read_links_wiki",
    base.cte("notes")
    + """SELECT DISTINCT n.path AS src, t.path AS dst FROM notes n JOIN notes t
         ON t.doc_id = n.doc_id + 1 OR t.doc_id = n.doc_id // 2""",
)
def s3_wiki(spark, sf):
    """Each note links to the next one by name, with an alias, and to another by heading."""
    written = F.concat(
        "content", F.lit(" [["), (F.col("doc_id") + 1).cast("string"), F.lit("|next]] and [["),
        F.floor(F.col("doc_id") / 2).cast("string"), F.lit("#part]] and [[nowhere]]"),
    )
    return read_links(base.notes(spark, sf).withColumn("content", written))


_PAYLOAD = "struct<version:int,ok:boolean,sourcePath:string,generatedAt:string,code:string," \
    "error:string,results:array<struct<path:string,title:string,score:double,excerpt:string,linked:boolean>>>"


@query(
    "s6_export_related",
    base.cte("related")
    + """, s AS (SELECT DISTINCT path AS source_path, number FROM idx)
    SELECT s.source_path, 1 AS version, number % 4 > 1 AS ok,
           '2024-05-06T07:08:09.000Z' AS generated_at,
           CASE number % 4 WHEN 0 THEN 'NO_ACTIVE_FILE' WHEN 1 THEN 'SEARCH_FAILED' END AS code,
           CASE number % 4 WHEN 0 THEN 'No active markdown file' WHEN 1 THEN 'index is down' END
               AS error,
           r.rank, r.path, r.title, round(r.similarity, 6) AS score,
           r.similar_chunk AS excerpt, r.is_linked AS linked
    FROM s LEFT JOIN related r ON r.source_path = s.source_path AND number % 4 > 1""",
)
def s6(spark, sf):
    """The documents, read back field by field."""
    index = base.index(spark, sf)
    results = related_notes(index, limit=10, links=base.links(spark, sf))
    sources = index.select(
        F.col("path").alias("source_path"),
        (F.col("number") % 4 > 0).alias("known"),
        F.when(F.col("number") % 4 == 1, "index is down").alias("error"),
    ).distinct()
    docs = export_related(results, sources, "2024-05-06 07:08:09")
    doc = docs.select("source_path", F.from_json("payload", _PAYLOAD).alias("d"))
    return doc.select(
        "source_path", "d.version", "d.ok", F.col("d.generatedAt").alias("generated_at"),
        "d.code", "d.error", F.posexplode_outer("d.results").alias("pos", "r"),
    ).select(
        "source_path", "version", "ok", "generated_at", "code", "error",
        (F.col("pos") + 1).alias("rank"), "r.path", "r.title",
        F.round("r.score", 6).alias("score"), "r.excerpt", "r.linked",
    )


@query(
    "s7_mtime_state",
    base.cte("state")
    + """, touched AS (SELECT path, mtime, doc_id FROM notes),
    put AS (SELECT path, mtime FROM state WHERE path NOT IN (SELECT path FROM touched WHERE doc_id % 3 = 0)
            UNION ALL SELECT path, 7 FROM touched WHERE doc_id % 3 = 0)
    SELECT path, mtime FROM put WHERE path NOT IN (SELECT path FROM touched WHERE doc_id % 3 = 1)""",
)
def s7(spark, sf):
    notes, state = base.notes(spark, sf), base.state(spark, sf)
    put = set_state(
        state, notes.filter("doc_id % 3 = 0").select("path", F.lit(7).cast("bigint").alias("mtime"))
    )
    return drop_state(put, notes.filter("doc_id % 3 = 1"))


@query(
    "s7_get_mtime",
    base.cte("state") + "SELECT n.path, s.mtime FROM notes n LEFT JOIN state s ON s.path = n.path",
)
def s7_get(spark, sf):
    return get_state(base.state(spark, sf), base.notes(spark, sf))


@query("s7_count_state", base.cte("state") + "SELECT count(*) AS n FROM state")
def s7_count(spark, sf):
    return count_state(base.state(spark, sf))


@query(
    "s8_errored_state",
    base.cte("errored")
    + """SELECT path, error, attempts FROM errored
         WHERE path NOT IN (SELECT path FROM notes WHERE doc_id % 4 = 0)
    UNION ALL SELECT path, 'again', 1 FROM notes WHERE doc_id % 4 = 0""",
)
def s8(spark, sf):
    rows = base.notes(spark, sf).filter("doc_id % 4 = 0").select(
        "path", F.lit("again").alias("error"), F.lit(1).alias("attempts"), "mtime"
    )
    return set_errored(base.errored(spark, sf), rows).select("path", "error", "attempts")


@query("s9_read_usage", base.cte("usage") + "SELECT ts, tokens FROM usage")
def s9(spark, sf):
    root = base.scratch(spark)
    append_usage(base.usage(spark, sf), root)
    return read_usage(spark, root).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "tokens")


# --- reports ----------------------------------------------------------------------------------------------

_STATUS = {
    "status": f"""SELECT path, CASE WHEN {base.GLOBS_SQL} THEN 'excluded'
        WHEN path IN (SELECT path FROM errored) THEN 'errored'
        WHEN path IN (SELECT path FROM state) THEN 'indexed' ELSE 'pending' END AS status
        FROM notes""",
}


def _inputs(spark, sf):
    return base.notes(spark, sf), base.state(spark, sf), base.errored(spark, sf)


@query("a1_note_status", base.cte("state", "errored", more=_STATUS) + "SELECT * FROM status")
def a1_rows(spark, sf):
    return note_status(*_inputs(spark, sf), base.GLOBS)


@query(
    "a1_index_status",
    base.cte("state", "errored", more=_STATUS)
    + """SELECT count(*) AS total, count(*) FILTER (status = 'excluded') AS excluded,
         count(*) FILTER (status = 'errored') AS errored,
         count(*) FILTER (status = 'indexed') AS indexed,
         count(*) FILTER (status = 'pending') AS pending FROM status""",
)
def a1(spark, sf):
    return index_status(*_inputs(spark, sf), base.GLOBS)


@query(
    "a2_visible_errored",
    base.cte("errored")
    + f"""SELECT path, error, attempts FROM errored
         WHERE path IN (SELECT path FROM notes) AND NOT {base.GLOBS_SQL}""",
)
def a2(spark, sf):
    notes, _, errored = _inputs(spark, sf)
    return visible_errored(errored, notes, base.GLOBS).select("path", "error", "attempts")


@query(
    "a3_index_counts",
    base.cte("state", "errored", "idx")
    + """SELECT (SELECT count(*) FROM state) AS indexed_notes, (SELECT count(*) FROM notes) AS total_notes,
         (SELECT count(*) FROM idx) AS chunks, (SELECT count(*) FROM errored) AS errored""",
)
def a3(spark, sf):
    notes, state, errored = _inputs(spark, sf)
    return index_counts(notes, state, base.index(spark, sf), errored)


@query(
    "a4_preview_list",
    base.cte("notes")
    + f""", x AS (SELECT path FROM notes WHERE {base.GLOBS_SQL})
    SELECT path, (SELECT greatest(count(*) - 100, 0) FROM x) AS more
    FROM x ORDER BY path LIMIT 100""",
)
def a4(spark, sf):
    excluded = base.notes(spark, sf).filter(is_excluded("path", base.GLOBS)).select("path")
    return preview_list(excluded)


_DAILY = {"daily": """SELECT CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens,
    count(*) AS request_count FROM usage GROUP BY 1"""}


@query("a5_usage_daily", base.cte("usage", more=_DAILY) + "SELECT * FROM daily")
def a5(spark, sf):
    return usage_daily(base.usage(spark, sf))


@query(
    "a6_usage_total",
    base.cte("usage")
    + """SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) AS request_count,
         coalesce(CAST(CAST(min(ts) AS DATE) AS VARCHAR), '') AS first_use_date FROM usage""",
)
def a6(spark, sf):
    return usage_total(base.usage(spark, sf))


@query(
    "a7_usage_retention",
    base.cte("usage", more=_DAILY)
    + f"SELECT * FROM daily WHERE day >= DATE '{base.ASOF}' - INTERVAL 30 DAY",
)
def a7(spark, sf):
    return usage_retention(usage_daily(base.usage(spark, sf)), base.ASOF)


@query(
    "a8_usage_cost",
    base.cte("usage", more=_DAILY)
    + """SELECT day, tokens, CASE WHEN day_no % 3 = 0 THEN NULL WHEN day_no % 3 = 1 THEN NULL
        ELSE '~$' || CAST(CAST(tokens / 1e6 * 13.7 AS DECIMAL(18, 4)) AS VARCHAR) END AS cost
    FROM (SELECT *, dayofmonth(day) AS day_no FROM daily)""",
)
def a8(spark, sf):
    """Days without a price, with a zero price, and with one."""
    number = F.dayofmonth("day") % 3
    price = F.when(number == 1, F.lit(0.0)).when(number == 2, F.lit(13.7))
    return usage_daily(base.usage(spark, sf)).select(
        "day", "tokens", usage_cost("tokens", price).alias("cost")
    )


@query(
    "a8_usage_today",
    base.cte("usage", more=_DAILY)
    + f"""SELECT DATE '{base.ASOF}' AS day,
         CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
         CAST(coalesce(sum(request_count), 0) AS BIGINT) AS request_count
    FROM daily WHERE day = DATE '{base.ASOF}'""",
)
def a8_today(spark, sf):
    return usage_today(usage_daily(base.usage(spark, sf)), base.ASOF)


@query(
    "a9_estimate_usage",
    """SELECT conv_id, CAST(sum(CASE WHEN a > 0.8 * n THEN ceil(n / 4) ELSE n END) AS BIGINT)
        AS tokens, 1 AS request_count
    FROM (SELECT conv_id, length(text) AS n,
                 length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a FROM conversations)
    GROUP BY conv_id""",
)
def a9(spark, sf):
    return estimate_usage(base.table(spark, sf, "conversations"), "conv_id")
