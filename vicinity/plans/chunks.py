"""Chunking and embedding queries."""

from pyspark.sql import functions as F

from vicinity.functions.vectors import normalize, pool_normalize, validate_chunks
from vicinity.operators.chunking import chunk_notes, chunk_size_sweep
from vicinity.operators.embedding import (
    HashEmbedder,
    RemoteEmbedder,
    embed_column,
    payload_batches,
    split_into_batches,
)
from vicinity.plans import base
from vicinity.plans.registry import query

_SRC = {"src": "SELECT path, title, content FROM notes"}


@query(
    "c1_chunk_notes",
    base.cte("notes", more={**_SRC, **base.chunk_ctes(512)}, recursive=True)
    + "SELECT path, title, content, chunk_index, total_chunks FROM chunks",
)
def c1(spark, sf):
    return chunk_notes(base.wide_notes(spark, sf))


@query(
    "c1_chunk_notes_small",
    base.cte("turns", more={"src": "SELECT path, title, content FROM turns",
                            **base.chunk_ctes(128)}, recursive=True)
    + "SELECT path, title, content, chunk_index, total_chunks FROM chunks",
)
def c1_small(spark, sf):
    return chunk_notes(base.turns(spark, sf), chunk_size=128)


@query(
    "c1_chunk_invariants",
    base.cte("notes")
    + "SELECT path, true AS within_size, true AS contiguous, true AS verbatim FROM notes",
)
def c1_invariants(spark, sf):
    """Chunks fit, are numbered without gaps and are found in the note as they are."""
    chunks = chunk_notes(base.wide_notes(spark, sf), chunk_size=256)
    notes = base.notes(spark, sf).select("path", F.col("content").alias("whole"))
    return (
        chunks.join(notes, "path")
        .groupBy("path")
        .agg(
            F.bool_and(F.octet_length("content") <= 512).alias("within_size"),
            ((F.max("chunk_index") + 1 == F.count("*")) & (F.max("total_chunks") == F.count("*"))
             & (F.min("chunk_index") == 0)).alias("contiguous"),
            F.bool_and(F.expr("contains(whole, content)")).alias("verbatim"),
        )
    )


_SIZES = (2048, 1024, 512, 256)


@query(
    "c9_chunk_size_sweep",
    base.cte(
        "notes",
        more={
            "wanted": """SELECT a.path AS src, b.path AS dst FROM notes a
                JOIN labels USING (doc_id) JOIN notes b ON b.doc_id = a.doc_id + 1""",
            "src": """SELECT path, title, content FROM notes
                WHERE path IN (SELECT src FROM wanted UNION SELECT dst FROM wanted)""",
            **{k: v for n in _SIZES for k, v in base.chunk_ctes(n, tag=f"_{n}").items()},
            "texts": " UNION ALL ".join(
                f"""SELECT {n} AS size, path, chunk_index, CASE WHEN chunk_index = 0
                    THEN title || chr(10) || chr(10) ELSE '' END || content AS text
                    FROM chunks_{n}"""
                for n in _SIZES
            ),
            **base.vector_ctes("texts", "size, path, chunk_index", "text", 256),
            "best": """SELECT l.size, src, dst, l.chunk_index AS src_chunk,
                r.chunk_index AS dst_chunk, round(list_cosine_similarity(
                    CAST(l.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])), 12) AS score
                FROM wanted JOIN vectors l ON l.path = src
                JOIN vectors r ON r.path = dst AND r.size = l.size
                QUALIFY row_number() OVER (PARTITION BY l.size, src, dst
                    ORDER BY score DESC, src_chunk, dst_chunk) = 1""",
        },
        recursive=True,
    )
    + "SELECT size, src, dst, src_chunk, dst_chunk, round(score, 6) AS score FROM best",
)
def c9(spark, sf):
    """Each labelled document against the next one."""
    notes = base.wide_notes(spark, sf)
    labelled = base.table(spark, sf, "labels").select("doc_id")
    nxt = notes.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst"))
    pairs = (
        notes.join(labelled, "doc_id")
        .select("doc_id", F.col("path").alias("src"))
        .join(nxt, "doc_id")
    )
    swept = chunk_size_sweep(notes, pairs, HashEmbedder(256))
    return swept.withColumn("score", F.round("score", 6))


_VALUES = """SELECT path, i AS dim, round(CAST(v[i + 1] AS DOUBLE), 6) AS value
    FROM vectors, range(64) r(i)"""


def _exploded(df, *keys):
    return df.select(*keys, F.posexplode("embedding").alias("dim", "x")).select(
        *keys, F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("x").cast("double"), 6).alias("value"),
    )


@query(
    "e1_embed_column",
    base.cte("turns", more=base.vector_ctes("turns", "path", "content", 64)) + _VALUES,
)
def e1(spark, sf):
    made = embed_column(base.turns(spark, sf).select("path", "content"), "content", HashEmbedder(64))
    return _exploded(made, "path")


@query(
    "e2_split_into_batches",
    base.cte("talks")
    + """SELECT path, chunk_index, CAST((row_number() OVER (PARTITION BY path
         ORDER BY chunk_index) - 1) // 3 AS INTEGER) AS batch_no FROM talks""",
)
def e2(spark, sf):
    return split_into_batches(base.talks(spark, sf), 3).select("path", "chunk_index", "batch_no")


@query(
    "e3_payload_batches",
    base.cte(
        "notes",
        more={
            **_SRC,
            **base.chunk_ctes(512),
            "ordered": "SELECT path, chunk_index, octet_length(encode(content)) AS bytes FROM chunks",
            "packed": """
                SELECT path, chunk_index, bytes, bytes AS used, 0 AS batch_no
                FROM ordered WHERE chunk_index = 0
                UNION ALL
                SELECT o.path, o.chunk_index, o.bytes,
                       CASE WHEN p.used + o.bytes > 3000 THEN o.bytes ELSE p.used + o.bytes END,
                       CASE WHEN p.used + o.bytes > 3000 THEN p.batch_no + 1 ELSE p.batch_no END
                FROM packed p JOIN ordered o
                  ON o.path = p.path AND o.chunk_index = p.chunk_index + 1""",
        },
        recursive=True,
    )
    + "SELECT path, chunk_index, CAST(bytes AS INTEGER) AS bytes, batch_no FROM packed",
)
def e3(spark, sf):
    return payload_batches(chunk_notes(base.wide_notes(spark, sf)), 3000)


def _shuffled_answers(texts):
    """A remote model that answers out of order, with positions."""
    vectors = HashEmbedder(64).embed_texts(texts)
    return list(enumerate(vectors))[::-1]


@query(
    "e5_remote_embedder",
    base.cte("turns", more=base.vector_ctes("turns", "path", "content", 64)) + _VALUES,
)
def e5(spark, sf):
    """Also e4: positions are put in order and counts are checked on the way."""
    remote = RemoteEmbedder(_shuffled_answers, dim=64, max_tokens=512)
    made = embed_column(base.turns(spark, sf).select("path", "content"), "content", remote)
    return _exploded(made, "path")


@query(
    "e4_check_response",
    """SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0
        THEN 'expected 1 embeddings, got 0' END AS error FROM conversations""",
)
def e4(spark, sf):
    """A model that loses some texts: their rows carry the error, their neighbours not."""

    def lossy(texts):
        kept = [t for t in texts if len(t) % 5]
        return HashEmbedder(64).embed_texts(kept)

    rows = base.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    made = embed_column(rows, "text", RemoteEmbedder(lossy, 64, 512, budget=None))
    return made.select("conv_id", "turn", "error")


@query(
    "e6_normalize",
    """SELECT vec_id, i AS dim, round(CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE
        CAST(embedding[i + 1] AS DOUBLE) * (vec_id % 9) / sqrt(list_dot_product(
            CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / (vec_id % 9) END, 6) AS value
    FROM embeddings, range(64) r(i)""",
)
def e6(spark, sf):
    scaled = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 9)
    )
    made = base.table(spark, sf, "embeddings").select("vec_id", normalize(scaled).alias("embedding"))
    return _exploded(made, "vec_id")


@query(
    "e6_pool_normalize",
    """WITH m AS (SELECT label, i AS dim, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x
                  FROM embeddings, range(64) r(i) GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label)
    SELECT label, dim, round(x / len, 6) AS value FROM m JOIN n USING (label)""",
)
def e6_pool(spark, sf):
    return _exploded(pool_normalize(base.table(spark, sf, "embeddings"), "label"), "label")


@query(
    "p6_validate_chunks",
    base.cte("idx")
    + """SELECT path, chunk_index, CASE vec_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty'
         WHEN 2 THEN 'size_mismatch' ELSE 'valid' END AS outcome FROM idx""",
)
def p6(spark, sf):
    broken = (
        F.when(F.col("vec_id") % 7 == 1, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 7 == 2, F.slice("embedding", 1, 10))
        .when(F.col("vec_id") % 7 > 2, F.col("embedding"))
    )
    chunks = base.index(spark, sf).withColumn("embedding", broken)
    valid, rejected = validate_chunks(chunks, 64)
    return valid.select("path", "chunk_index", F.lit("valid").alias("outcome")).unionByName(
        rejected.select("path", "chunk_index", F.col("reason").alias("outcome"))
    )
