"""Note tables derived from the given tables, in Spark and in SQL.

The given tables hold no notes. Both sides derive them by the same mapping; ``cte``
gives the SQL side. Every mapping covers its whole table.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.lineage import checkpoint_dir
from vicinity.session import spread_few_files

GLOBS = ("src1/", "**/fr/*", "src2/{de,es}/*", "src?/en/1*.md")
GLOBS_SQL = (
    "(path LIKE 'src1/%' OR regexp_matches(path, '/fr/[^/]+$') OR path LIKE 'src2/de/%' "
    "OR path LIKE 'src2/es/%' OR regexp_full_match(path, 'src[^/]/en/1[^/]*\\.md'))"
)
ASOF = "2024-02-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much more to process than to move."""
    return spread_few_files(table(spark, sf_dir, name))


def _text(c) -> F.Column:
    return F.col(c).cast("string")


def notes(spark, sf_dir) -> DataFrame:
    """Documents as notes; the character count stands in for the mtime."""
    return as_notes(table(spark, sf_dir, "documents"))


def wide_notes(spark, sf_dir) -> DataFrame:
    return as_notes(wide(spark, sf_dir, "documents"))


def as_notes(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), _text("doc_id"), F.lit(".md")).alias("path"),
        _text("doc_id").alias("title"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("mtime"),
        "doc_id",
    )


def state(spark, sf_dir) -> DataFrame:
    """Labelled documents of good quality as indexed, the others as deleted notes."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    good = (
        notes(spark, sf_dir)
        .join(labels.filter("quality = 1").select("doc_id"), "doc_id")
        .select("path", (F.col("mtime") + F.col("doc_id") % 2).alias("mtime"))
    )
    gone = labels.filter("quality = 0").select(
        F.concat(F.lit("gone/"), _text("doc_id"), F.lit(".md")).alias("path"),
        F.col("doc_id").alias("mtime"),
    )
    return good.unionByName(gone)


def errored(spark, sf_dir) -> DataFrame:
    """Every 11th document as failed, half of them edited since, and failures of notes
    that no longer exist."""
    live = notes(spark, sf_dir).filter("doc_id % 11 = 0").select(
        "path",
        F.concat(F.lit("fetch failed "), "title").alias("error"),
        F.lit(3).alias("attempts"),
        (F.col("mtime") + F.col("doc_id") % 2).alias("mtime"),
        F.timestamp_seconds(F.col("doc_id")).alias("last_tried_at"),
    )
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("lost/"), _text("doc_id"), F.lit(".md")).alias("path"),
        F.lit("network down").alias("error"),
        F.lit(3).alias("attempts"),
        F.col("doc_id").alias("mtime"),
        F.timestamp_seconds(F.col("doc_id")).alias("last_tried_at"),
    )
    return live.unionByName(gone)


def note_path(number: F.Column) -> F.Column:
    """Path of a numbered note; pairs of notes share a file name."""
    return F.concat(
        F.lit("f"), (number % 4).cast("string"), F.lit("/n"),
        F.floor(number / 2).cast("string"), F.lit(".md"),
    )


def index(spark, sf_dir) -> DataFrame:
    """Embeddings as an index, five chunks to a note."""
    number = F.floor(F.col("vec_id") / 5)
    return table(spark, sf_dir, "embeddings").select(
        note_path(number).alias("path"),
        F.concat(F.lit("note "), (number % 7).cast("string")).alias("title"),
        F.concat(F.lit("chunk "), _text("vec_id")).alias("content"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"),
        F.lit(5).alias("total_chunks"),
        "embedding",
        number.alias("number"),
        "label",
        "vec_id",
    )


def links(spark, sf_dir) -> DataFrame:
    """A note links to the notes up to three ahead, by the labels of its chunks."""
    number = F.floor(F.col("vec_id") / 5)
    target = number + F.col("label") % 3 + 1
    return table(spark, sf_dir, "embeddings").select(
        note_path(number).alias("src"), note_path(target).alias("dst")
    ).distinct()


def live_notes(spark, sf_dir) -> DataFrame:
    """The notes of the index without every sixth."""
    return index(spark, sf_dir).filter("number % 6 <> 0").select("path", "title").distinct()


def talks(spark, sf_dir) -> DataFrame:
    """Conversations as notes with one chunk per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talk/"), _text("conv_id"), F.lit(".md")).alias("path"),
        _text("conv_id").alias("title"),
        F.col("text").alias("content"),
        F.col("turn").cast("int").alias("chunk_index"),
        "role",
    )


def turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as one note each."""
    name = F.concat(F.lit("t"), _text("conv_id"), F.lit("-"), _text("turn"))
    return wide(spark, sf_dir, "conversations").select(
        F.concat("role", F.lit("/"), name, F.lit(".md")).alias("path"),
        name.alias("title"),
        F.col("text").alias("content"),
        F.length("text").cast("bigint").alias("mtime"),
        "role",
        "conv_id",
        "turn",
    )


def events(spark, sf_dir) -> DataFrame:
    """User events as file events; a purchase renames the user's file."""
    return events_from(table(spark, sf_dir, "events"))


def events_from(raw: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "purchase", "rename")
        .otherwise("modify")
    )
    user = _text("user_id")
    folder = F.when(F.col("user_id") % 4 == 0, "Archive/").otherwise("Notes/")
    own = F.concat(folder, user, F.when(F.col("user_id") % 13 == 0, ".png").otherwise(".md"))
    moved = F.concat(F.lit("Moved/"), user, F.lit(".md"))
    rename = F.col("event_type") == "purchase"
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(rename, moved).otherwise(own).alias("path"),
        F.when(rename, own).alias("old_path"),
        F.col("event_id").alias("mtime"),
    )


def usage(spark, sf_dir) -> DataFrame:
    """Events as requests, with the tokens of their properties."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


# --- the same in SQL --------------------------------------------------------------------

_N = "(vec_id // 5)"


def note_path_sql(n: str) -> str:
    return f"'f' || ({n} % 4) || '/n' || ({n} // 2) || '.md'"


_CTE = {
    "notes": """
        SELECT source || '/' || lang || '/' || doc_id || '.md' AS path,
               CAST(doc_id AS VARCHAR) AS title, text AS content, n_chars AS mtime, doc_id
        FROM documents""",
    "state": """
        SELECT path, mtime + doc_id % 2 AS mtime
        FROM notes JOIN labels USING (doc_id) WHERE quality = 1
        UNION ALL SELECT 'gone/' || doc_id || '.md', doc_id FROM labels WHERE quality = 0""",
    "errored": """
        SELECT path, 'fetch failed ' || title AS error, 3 AS attempts,
               mtime + doc_id % 2 AS mtime
        FROM notes WHERE doc_id % 11 = 0
        UNION ALL SELECT 'lost/' || doc_id || '.md', 'network down', 3, doc_id
        FROM labels WHERE toxic = 1""",
    "idx": f"""
        SELECT {note_path_sql(_N)} AS path, 'note ' || ({_N} % 7) AS title,
               'chunk ' || vec_id AS content, CAST(vec_id % 5 AS INTEGER) AS chunk_index,
               5 AS total_chunks, CAST(embedding AS DOUBLE[]) AS v, {_N} AS number,
               label, vec_id
        FROM embeddings""",
    "links": f"""
        SELECT DISTINCT {note_path_sql(_N)} AS src,
               {note_path_sql(f"({_N} + label % 3 + 1)")} AS dst
        FROM embeddings""",
    "live": "SELECT DISTINCT path, title FROM idx WHERE number % 6 <> 0",
    "talks": """
        SELECT 'talk/' || conv_id || '.md' AS path, CAST(conv_id AS VARCHAR) AS title,
               text AS content, CAST(turn AS INTEGER) AS chunk_index, role
        FROM conversations""",
    "turns": """
        SELECT role || '/t' || conv_id || '-' || turn || '.md' AS path,
               't' || conv_id || '-' || turn AS title, text AS content,
               length(text) AS mtime, role, conv_id, turn
        FROM conversations""",
    "own": """
        SELECT *, CASE WHEN user_id % 4 = 0 THEN 'Archive/' ELSE 'Notes/' END || user_id
               || CASE WHEN user_id % 13 = 0 THEN '.png' ELSE '.md' END AS own
        FROM events""",
    "feed": """
        SELECT ts, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete'
                    WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS kind,
               CASE WHEN event_type = 'purchase' THEN 'Moved/' || user_id || '.md'
                    ELSE own END AS path,
               CASE WHEN event_type = 'purchase' THEN own END AS old_path,
               event_id AS mtime
        FROM own""",
    "usage": """
        SELECT ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events""",
    "pairs": """
        SELECT s.path AS source_path, s.chunk_index AS source_chunk_index, t.path,
               t.chunk_index, round(list_cosine_similarity(s.v, t.v), 12) AS score
        FROM idx s JOIN idx t ON s.path <> t.path""",
    "hits": """
        SELECT *, row_number() OVER (PARTITION BY source_path, source_chunk_index
                                     ORDER BY score DESC, path, chunk_index) AS rank
        FROM pairs WHERE score >= 0 QUALIFY rank <= 15""",
    "best": """
        SELECT source_path, path, score AS similarity, source_chunk_index, chunk_index
        FROM hits
        QUALIFY row_number() OVER (PARTITION BY source_path, path
                                   ORDER BY score DESC, source_chunk_index, chunk_index) = 1""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY source_path
                                     ORDER BY similarity DESC, path) AS rank
        FROM best QUALIFY rank <= 10""",
    "related": """
        SELECT r.source_path, r.path, r.similarity, r.source_chunk_index, r.chunk_index,
               CAST(r.rank AS INTEGER) AS rank, t.title, t.content AS similar_chunk,
               s.content AS source_chunk, l.dst IS NOT NULL AS is_linked
        FROM ranked r
        JOIN idx t ON t.path = r.path AND t.chunk_index = r.chunk_index
        JOIN idx s ON s.path = r.source_path AND s.chunk_index = r.source_chunk_index
        LEFT JOIN links l ON l.src = r.source_path AND l.dst = r.path""",
}

_NEEDS = {
    "state": ["notes"],
    "errored": ["notes"],
    "live": ["idx"],
    "feed": ["own"],
    "pairs": ["idx"],
    "hits": ["pairs"],
    "best": ["hits"],
    "ranked": ["best"],
    "related": ["ranked", "links"],
}


def cte(*names: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` clause of the named tables and what they need, then ``more``."""
    order: list[str] = []

    def add(name):
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_CTE[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


# Chunks of ``src(path, title, content)`` in SQL. The texts at hand have no markdown
# separators and no word as long as a chunk, so two levels suffice: lines, and the words
# of lines that are too long, or of a text of one line only. ``b`` numbers the runs that are merged on their own.
def chunk_ctes(size: int, overlap: int = 100, tag: str = "") -> dict[str, str]:
    """Tables that end in ``chunks``; a ``tag`` keeps several sizes apart."""
    tables = _chunk_ctes(size, overlap)
    if not tag:
        return tables
    names = re.compile(r"\b(" + "|".join(tables) + r")\b")
    return {n + tag: names.sub(rf"\g<1>{tag}", body) for n, body in tables.items()}


def _chunk_ctes(size: int, overlap: int) -> dict[str, str]:
    tokens = "(octet_length(encode({0})) + 1) // 2"
    line_tokens, word_tokens = tokens.format("line"), tokens.format("piece")
    return {
        "lines": """
            SELECT path, title, content, unnest(range(1, len(parts) + 1)) AS line_no,
                   unnest(parts) AS raw
            FROM (SELECT *, string_split(content, chr(10)) AS parts FROM src)""",
        "pieces0": """
            SELECT path, line_no, NOT contains(content, chr(10)) AS single,
                   CASE WHEN line_no > 1 THEN chr(10) || raw ELSE raw END AS line
            FROM lines""",
        "sized": f"""
            SELECT *, {line_tokens} AS n, single OR {line_tokens} >= {size} AS long
            FROM pieces0 WHERE line <> ''""",
        "runs": """
            SELECT *, sum(CASE WHEN long OR coalesce(was_long, false) THEN 1 ELSE 0 END)
                      OVER (PARTITION BY path ORDER BY line_no) AS b
            FROM (SELECT *, lag(long) OVER (PARTITION BY path ORDER BY line_no) AS was_long
                  FROM sized)""",
        "words": """
            SELECT path, b, line_no, unnest(range(1, len(parts) + 1)) AS word_no,
                   unnest(parts) AS raw
            FROM (SELECT *, string_split(line, ' ') AS parts FROM runs WHERE long)""",
        "pieces1": f"""
            SELECT path, b, line_no, 0 AS word_no, line AS piece, n FROM runs WHERE NOT long
            UNION ALL
            SELECT path, b, line_no, word_no, piece, {word_tokens} FROM
                (SELECT *, CASE WHEN word_no > 1 THEN ' ' || raw ELSE raw END AS piece
                 FROM words) WHERE piece <> ''""",
        "pieces": """
            SELECT path, b, piece, n,
                   row_number() OVER w AS i,
                   sum(n) OVER (PARTITION BY path, b ORDER BY line_no, word_no
                                ROWS UNBOUNDED PRECEDING) AS upto
            FROM pieces1 WINDOW w AS (PARTITION BY path, b ORDER BY line_no, word_no)""",
        # first piece and last piece of each chunk; a step finds the end of a chunk and
        # the start of the next one
        "spans": f"""
            SELECT path, b, CAST(1 AS BIGINT) AS a,
                   (SELECT coalesce(min(CASE WHEN p.upto > {size} AND p.i > 1 THEN p.i END) - 1,
                                    max(p.i))
                    FROM pieces p WHERE p.path = s.path AND p.b = s.b) AS z
            FROM (SELECT DISTINCT path, b FROM pieces) s
            UNION ALL
            SELECT path, b, a2,
                   (SELECT coalesce(min(CASE WHEN p.upto - before > {size} AND p.i > a2
                                             THEN p.i END) - 1, max(p.i))
                    FROM pieces p WHERE p.path = t.path AND p.b = t.b AND p.i >= a2)
            FROM (SELECT path, b, a2,
                         (SELECT coalesce(max(p.upto), 0) FROM pieces p
                          WHERE p.path = u.path AND p.b = u.b AND p.i < u.a2) AS before
                  FROM (SELECT s.path, s.b,
                               (SELECT coalesce(min(CASE WHEN e.upto - (q.upto - q.n) <= {overlap}
                                                          AND f.upto - (q.upto - q.n) <= {size}
                                                         THEN q.i END), s.z + 1)
                                FROM pieces q, pieces e, pieces f
                                WHERE q.path = s.path AND q.b = s.b AND q.i BETWEEN s.a AND s.z
                                  AND e.path = s.path AND e.b = s.b AND e.i = s.z
                                  AND f.path = s.path AND f.b = s.b AND f.i = s.z + 1) AS a2
                        FROM spans s
                        WHERE EXISTS (SELECT 1 FROM pieces p WHERE p.path = s.path
                                      AND p.b = s.b AND p.i = s.z + 1)) u) t""",
        "joined": """
            SELECT s.path, s.b, s.a,
                   trim(string_agg(p.piece, '' ORDER BY p.i), ' ' || chr(10)) AS content
            FROM spans s JOIN pieces p
              ON p.path = s.path AND p.b = s.b AND p.i BETWEEN s.a AND s.z
            GROUP BY s.path, s.b, s.a""",
        "chunks": """
            SELECT path, src.title, j.content,
                   CAST(row_number() OVER (PARTITION BY path ORDER BY b, a) - 1 AS INTEGER)
                       AS chunk_index,
                   CAST(count(*) OVER (PARTITION BY path) AS INTEGER) AS total_chunks
            FROM joined j JOIN src USING (path) WHERE j.content <> ''""",
    }


def vector_ctes(source: str, key: str, text: str, dim: int, out: str = "vectors") -> dict[str, str]:
    """Hashed bag-of-words vectors of ``source``: ``key`` columns and ``v``."""
    cols = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"g.{c} = c.{c}" for c in cols)
    ks = ", ".join(f"c.{c}" for c in cols)
    return {
        f"{out}_words": f"""
            SELECT {key}, unnest(string_split_regex(lower({text}), '[ \\t\\n\\f\\r\\v]+')) AS w
            FROM {source}""",
        f"{out}_counts": f"""
            SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS d, count(*) AS n
            FROM {out}_words WHERE w <> '' GROUP BY ALL""",
        f"{out}_maps": f"""
            SELECT {key}, map_from_entries(list((d, n))) AS m,
                   sqrt(sum(n * n)) AS len FROM {out}_counts GROUP BY {key}""",
        out: f"""
            SELECT {ks}, [CAST(coalesce(g.m[i], 0) / coalesce(g.len, 1) AS FLOAT)
                          FOR i IN range({dim})] AS v
            FROM {source} c LEFT JOIN {out}_maps g ON {on}""",
    }
