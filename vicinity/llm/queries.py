"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import (
    embeddings,
    exact,
    imatch,
    language,
    negatives,
    packing,
    pieces,
    quality,
    quotations,
    repair,
    sharding,
    simhash,
    tries,
)
from vicinity.llm.common import workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query()
def op2_sentencepiece(spark, sf_dir) -> DataFrame:
    return pieces.round_trip(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    )


#: Brute force over all pairs; the index can miss a link, on the given tables it does not.
@query(
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE len(embedding) > 0 AND NOT list_bool_or([coalesce(NOT isfinite(c), true) FOR c IN embedding])
              AND list_bool_or([c <> 0 FOR c IN embedding])),
    links AS (
        SELECT s.vec_id AS a, t.vec_id AS b FROM v s JOIN v t ON s.vec_id <> t.vec_id
        WHERE list_cosine_similarity(s.x, t.x) >= 0.9),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links,
           min(b) AS component_id, a = min(b) AS kept
    FROM reach r GROUP BY a
    """
)
def op3_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW g AS (PARTITION BY t)
    """
)
def op4_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query(
    """
    WITH RECURSIVE rows AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS rid
        FROM conversations),
    lines AS (
        SELECT conv_id, turn, rid, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM rows)),
    marked AS (
        SELECT conv_id, turn, rid, pos, length(replace(replace(marks, ' ', ''), chr(9), '')) AS level,
               trim(line[length(marks) + 1:], ' ' || chr(9)) AS body
        FROM (SELECT *, regexp_extract(line, '^(?:[ \\t]*>)*') AS marks FROM lines)),
    begun AS (
        SELECT *, body = '' OR coalesce(lag(level) OVER w <> level OR lag(body) OVER w = '', true) AS begins
        FROM marked WINDOW w AS (PARTITION BY rid ORDER BY pos)),
    parts AS (
        SELECT conv_id, turn, rid, place, level, string_agg(body, chr(10) ORDER BY pos) AS body
        FROM (SELECT *, sum(begins::INT) OVER (PARTITION BY rid ORDER BY pos) AS place FROM begun)
        WHERE body <> '' GROUP BY ALL),
    known AS (
        SELECT *, lower(regexp_replace(body, '\\s+', ' ', 'g')) AS norm FROM parts
        WHERE length(regexp_replace(body, '[^\\p{L}\\p{N}]', '', 'g')) >= 8),
    near AS (SELECT norm, conv_id, min(turn) AS near FROM known WHERE level = 0 GROUP BY ALL),
    found AS (
        SELECT q.rid, q.place, q.level,
               coalesce((SELECT n.conv_id FROM near n WHERE n.norm = q.norm AND n.conv_id = q.conv_id
                         AND n.near < q.turn),
                        (SELECT min(n.conv_id) FROM near n WHERE n.norm = q.norm
                         AND n.conv_id <> q.conv_id)) AS from_conv, q.norm
        FROM known q WHERE level > 0),
    links AS (
        SELECT f.rid, count(*) AS linked,
               min(CASE WHEN level = 1 THEN {'place': place, 'conv': from_conv, 'turn': near} END) AS first
        FROM found f JOIN near n ON n.norm = f.norm AND n.conv_id = f.from_conv GROUP BY f.rid),
    whole AS (
        SELECT r.rid, r.conv_id, r.turn, r.role,
               coalesce((SELECT string_agg(body, chr(10) || chr(10) ORDER BY place) FROM parts p
                         WHERE p.rid = r.rid AND level = 0), '') AS own_text,
               (SELECT count(*) FROM parts p WHERE p.rid = r.rid AND level > 0) AS quotes,
               coalesce(linked, 0) AS linked, first.conv AS parent_conv, first.turn AS parent_turn
        FROM rows r LEFT JOIN links USING (rid)),
    chain AS (
        SELECT rid, conv_id, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM whole
        UNION ALL
        SELECT c.rid, c.conv_id, w.parent_turn, c.depth + 1
        FROM chain c JOIN whole w ON w.conv_id = c.conv_id AND w.turn = c.root_turn
        WHERE w.parent_conv = w.conv_id)
    SELECT w.* EXCLUDE (rid), c.root_turn, c.depth,
           row_number() OVER (PARTITION BY w.conv_id ORDER BY c.root_turn, c.depth, w.turn) - 1 AS position
    FROM whole w JOIN (SELECT rid, min(root_turn) AS root_turn, max(depth) AS depth FROM chain GROUP BY rid) c
    USING (rid)
    """
)
def op5_quotation_linking(spark, sf_dir) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


@query()
def op6_best_fit_packing(spark, sf_dir) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op7_token_files(spark, sf_dir) -> DataFrame:
    path = f"{workspace(spark)}/tokens"
    docs = table(spark, sf_dir, "documents")
    repair.write_tokens(docs, path, vocabulary("word_bpe_49k.json"), 49408)
    return repair.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query()
def op8_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


@query()
def op9_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op10_sharding(spark, sf_dir) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    """
    WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    marked AS (
        SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good,
               max(coalesce(toxic = 1, false)::INT) AS toxic
        FROM labels GROUP BY doc_id),
    split AS (
        SELECT *, [w FOR w IN string_split_regex(t, '[ \\t-\\r]+') IF w <> ''] AS words FROM docs),
    fails AS (
        SELECT part, doc_id, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
               regexp_matches(t, '[#$%&*|]'),
               coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
        FROM split),
    counted AS (
        SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM fails LEFT JOIN marked USING (doc_id) GROUP BY ALL),
    letters AS (SELECT unnest(range(1, 6)) AS i),
    orders AS (
        SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps AS (
        SELECT part, o, i AS step, n, good, toxic, f[o[i]] AS failed, list_bool_or([f[k] FOR k IN o[:i - 1]]) AS gone,
               list_sum([k::INT FOR k IN f]) AS failures
        FROM counted, orders, letters),
    results AS (
        SELECT part, o, step, sum(CASE WHEN NOT failed AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN failed AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS toxic_lost
        FROM steps GROUP BY ALL)
    SELECT part, array_to_string(['ABCDE'[k] FOR k IN o], '') AS filter_order, step::INT AS step,
           kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
    FROM results
    """
)
def op11_filter_audit(spark, sf_dir) -> DataFrame:
    return tries.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    """
    WITH taken AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
               list_inner_product(a.x::DOUBLE[], r.x::DOUBLE[])::BIGINT AS score
        FROM taken a JOIN taken r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT * FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10
    """
)
def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query()
def op13_document_fingerprints(spark, sf_dir) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))
