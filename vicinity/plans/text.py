"""Text, path and token queries."""

from pyspark.sql import functions as F

from vicinity.functions.globs import exclude_paths
from vicinity.functions.text import (
    classify_error,
    embed_text,
    exclude_content,
    min_query_length,
    nonempty_content,
    path_hash,
    strip_frontmatter,
)
from vicinity.functions.tokens import (
    check_token_limit,
    chunk_size,
    chunk_token_profile,
    count_tokens,
    truncate_to_tokens,
)
from vicinity.plans import base
from vicinity.plans.registry import query

_FRONT = "'---' || chr(10) || 'title: ' || doc_id || chr(10) || '---' || chr(10) || content"


@query(
    "p1_strip_frontmatter",
    base.cte("notes")
    + "SELECT path, CASE doc_id % 4 WHEN 1 THEN '---' || chr(10) || 'open: ' || content "
    "WHEN 2 THEN content || chr(10) || '---' ELSE content END AS content FROM notes",
)
def p1(spark, sf):
    front = F.concat(F.lit("---\ntitle: "), "title", F.lit("\n---\n"), "content")
    written = (
        F.when(F.col("doc_id") % 4 == 0, front)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("---\nopen: "), "content"))
        .when(F.col("doc_id") % 4 == 2, F.concat("content", F.lit("\n---")))
        .otherwise(F.col("content"))
    )
    return base.notes(spark, sf).select("path", strip_frontmatter(written).alias("content"))


@query(
    "p2_exclude_content",
    base.cte("notes")
    + r"""SELECT path, regexp_replace(regexp_replace(regexp_replace(content,
        '\bthe\b', '', 'g'), '[0-9]+', '', 'g'), '(?m)^\S+ ', '', 'g') AS content FROM notes""",
)
def p2(spark, sf):
    patterns = [r"\bthe\b", r"[0-9]+", "(unclosed", r"^\S+ "]
    return base.wide_notes(spark, sf).select(
        "path", exclude_content("content", patterns).alias("content")
    )


@query(
    "p3_exclude_paths",
    base.cte("notes") + f"SELECT path, mtime FROM notes WHERE NOT {base.GLOBS_SQL}",
)
def p3(spark, sf):
    return exclude_paths(base.notes(spark, sf), base.GLOBS).select("path", "mtime")


@query(
    "p4_nonempty_content",
    base.cte("notes") + "SELECT path, mtime FROM notes WHERE doc_id % 3 = 2",
)
def p4(spark, sf):
    emptied = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("content"))
    return nonempty_content(base.notes(spark, sf).withColumn("content", emptied)).select(
        "path", "mtime"
    )


@query(
    "p5_embed_text",
    base.cte("talks")
    + "SELECT path, chunk_index, CASE WHEN chunk_index = 0 THEN title || chr(10) || chr(10) "
    "ELSE '' END || content AS text FROM talks",
)
def p5(spark, sf):
    return base.talks(spark, sf).select(
        "path", "chunk_index", embed_text("title", "content", "chunk_index").alias("text")
    )


@query("p7_path_hash", base.cte("notes") + "SELECT path, sha256(path) AS path_hash FROM notes")
def p7(spark, sf):
    return base.notes(spark, sf).select("path", path_hash("path").alias("path_hash"))


_MESSAGE = """CASE event_id % 9
    WHEN 0 THEN 'WebGPU device lost ' || event_id
    WHEN 1 THEN 'Failed to get GPU adapter'
    WHEN 2 THEN 'Failed to fetch models/x'
    WHEN 3 THEN 'Cannot connect to host ' || user_id
    WHEN 4 THEN 'model not available'
    WHEN 5 THEN 'API_KEY_INVALID'
    WHEN 6 THEN 'RESOURCE_EXHAUSTED: ' || user_id
    WHEN 7 THEN 'no such models/' || user_id
    ELSE repeat('x', CAST(event_id % 200 AS INTEGER)) || ' in ' || event_type END"""


@query(
    "p14_classify_error",
    f"""WITH e AS (SELECT event_id, {_MESSAGE} AS m FROM events)
    SELECT event_id, CASE
        WHEN contains(m, 'webgpu') OR contains(m, 'WebGPU')
            THEN 'GPU acceleration failed - try disabling GPU in settings'
        WHEN contains(m, 'Failed to get GPU adapter')
            THEN 'GPU not available - disable GPU acceleration in settings'
        WHEN contains(m, 'network') OR contains(m, 'fetch')
            THEN 'Network error - check your internet connection'
        WHEN contains(m, 'Cannot connect')
            THEN 'Cannot connect to Ollama server - check if Ollama is running'
        WHEN contains(m, 'not available')
            THEN 'Model not found - check if model is installed in Ollama'
        WHEN contains(m, 'API key not valid') OR contains(m, 'INVALID_API_KEY')
             OR contains(m, 'API_KEY_INVALID')
            THEN 'Invalid API key - check your Google AI Studio API key'
        WHEN contains(m, 'quota exceeded') OR contains(m, 'RESOURCE_EXHAUSTED')
            THEN 'API quota exceeded - check your Google AI Studio usage limits'
        WHEN contains(m, 'model not found') OR contains(m, 'MODEL_NOT_FOUND')
             OR contains(m, 'models/')
            THEN 'Model not found - check if the model ID is correct'
        WHEN contains(m, 'PERMISSION_DENIED')
            THEN 'Permission denied - check your API key permissions'
        WHEN length(m) > 100 THEN left(m, 100) || '...' ELSE m END AS message FROM e""",
)
def p14(spark, sf):
    events = base.table(spark, sf, "events").withColumn("m", F.expr(_MESSAGE))
    return events.select("event_id", classify_error("m").alias("message"))


@query(
    "p15_min_query_length",
    """SELECT conv_id, turn, text FROM conversations
    WHERE length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) >= 60""",
)
def p15(spark, sf):
    return min_query_length(
        base.table(spark, sf, "conversations").select("conv_id", "turn", "text"), 60
    )


_MODELS = """SELECT p_partkey AS model, p_size * 64 AS detected,
    CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0
         ELSE CAST(p_size * (p_partkey % 7 + 1) * 16 + 1 AS INTEGER) END AS context FROM part"""


@query(
    "c2_chunk_size",
    f"""WITH m AS ({_MODELS}),
    c AS (SELECT *, CASE WHEN context > 0
                         THEN least(detected, CAST(floor(context * 0.5) AS INTEGER))
                         ELSE detected END AS max_tokens FROM m)
    SELECT model, max_tokens, least(512, max_tokens) AS chunk_size FROM c""",
)
def c2(spark, sf):
    base.table(spark, sf, "part").createOrReplaceTempView("vicinity_part")
    models = spark.sql(_MODELS.replace("FROM part", "FROM vicinity_part"))
    return chunk_size(models).select("model", "max_tokens", "chunk_size")


_MIXED = """CASE doc_id % 3 WHEN 0 THEN text || repeat(chr(128512), 5)
    WHEN 1 THEN regexp_replace(text, '[a-m]', 'é', 'g') ELSE text END"""


def _mixed(spark, sf):
    """Documents with some emoji and some texts that are mostly not ASCII."""
    changed = (
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\U0001F600" * 5)))
        .when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", "[a-m]", "é"))
        .otherwise(F.col("text"))
    )
    return base.wide(spark, sf, "documents").select("doc_id", changed.alias("text"))


@query(
    "c3_count_tokens_bytes",
    f"""SELECT doc_id, CAST(ceil(octet_length(encode({_MIXED})) / 2) AS INTEGER) AS tokens
    FROM documents""",
)
def c3(spark, sf):
    return _mixed(spark, sf).select("doc_id", count_tokens("text", "bytes").alias("tokens"))


_ASCII_TOKENS = r"""(SELECT CAST(CASE WHEN u = 0 OR a / u > 0.8 THEN ceil(u / 4) ELSE u END AS INTEGER)
    FROM (SELECT length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS u,
                 length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g')) AS a))"""


@query(
    "c4_count_tokens_ascii",
    f"WITH t AS (SELECT doc_id, {_MIXED} AS text FROM documents) "
    f"SELECT doc_id, {_ASCII_TOKENS.format('text')} AS tokens FROM t",
)
def c4(spark, sf):
    return _mixed(spark, sf).select("doc_id", count_tokens("text", "ascii").alias("tokens"))


@query(
    "c5_count_tokens_udf",
    """SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n]+'),
       lambda w: w <> '')) AS INTEGER) AS tokens FROM conversations""",
)
def c5(spark, sf):
    def words(texts):
        return [len(t.split()) for t in texts]

    return base.table(spark, sf, "conversations").select(
        "conv_id", "turn", count_tokens("text", words).alias("tokens")
    )


@query(
    "c6_check_token_limit",
    """SELECT conv_id, turn, CAST((octet_length(encode(text)) + 1) // 2 AS INTEGER) AS token_count,
       128 AS max_tokens, (octet_length(encode(text)) + 1) // 2 > 128 AS is_over_limit
    FROM conversations""",
)
def c6(spark, sf):
    return check_token_limit(base.table(spark, sf, "conversations"), 128).select(
        "conv_id", "turn", "token_count", "max_tokens", "is_over_limit"
    )


@query(
    "c7_truncate_bytes",
    f"""WITH t AS (SELECT doc_id, {_MIXED} AS text FROM documents),
    n AS (SELECT doc_id, text, unnest(range(20, 102)) AS n FROM t),
    best AS (SELECT doc_id, max(n) AS n FROM n
             WHERE octet_length(encode(left(text, CAST(n AS INTEGER)))) <= 101 - 1 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 100 THEN text
                        ELSE left(text, CAST(n AS INTEGER)) END AS text
    FROM t LEFT JOIN best USING (doc_id)""",
)
def c7(spark, sf):
    return _mixed(spark, sf).select("doc_id", truncate_to_tokens("text", 50).alias("text"))


@query(
    "c7_truncate_ascii",
    f"""WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0
             THEN regexp_replace(text, '[a-m]', 'é', 'g') ELSE text END AS text FROM documents),
    s AS (SELECT doc_id, text, 0 AS lo, CAST(length(text) AS INTEGER) AS hi FROM t
          UNION ALL
          SELECT doc_id, text, CASE WHEN fits THEN mid ELSE lo END, CASE WHEN fits THEN hi ELSE mid - 1 END
          FROM (SELECT *, {_ASCII_TOKENS.format('cut')} <= 64 AS fits
                FROM (SELECT *, (lo + hi + 1) // 2 AS mid, left(text, (lo + hi + 1) // 2) AS cut
                      FROM s WHERE lo < hi)))
    SELECT doc_id, CASE WHEN {_ASCII_TOKENS.format('text')} <= 64 THEN text
                        ELSE left(text, lo) END AS text
    FROM s WHERE lo = hi""",
)
def c7_ascii(spark, sf):
    changed = F.when(
        F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[a-m]", "é")
    ).otherwise(F.col("text"))
    docs = base.wide(spark, sf, "documents").select("doc_id", changed.alias("text"))
    return docs.select("doc_id", truncate_to_tokens("text", 64, "ascii").alias("text"))


@query(
    "c8_chunk_token_profile",
    base.cte("talks")
    + """SELECT path, count(*) AS chunks, min(t) AS min_tokens, max(t) AS max_tokens,
       CAST(sum(t) AS BIGINT) AS sum_tokens, quantile_disc(t, 0.5) AS median_tokens
    FROM (SELECT path, CAST((octet_length(encode(content)) + 1) // 2 AS INTEGER) AS t FROM talks)
    GROUP BY path""",
)
def c8(spark, sf):
    return chunk_token_profile(base.talks(spark, sf))
