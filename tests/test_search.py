import pytest
from pyspark.sql import functions as F
from tests.util import chunks_of, notes_of

from vicinity.operators.embedding import HashEmbedder, embed_column
from vicinity.operators.search import (
    best_pairs,
    display_name,
    drop_stale,
    exclude_self,
    flag_linked,
    fresh_chunks,
    min_similarity,
    rank_targets,
    recommend,
    related_notes,
    search_text,
    source_chunk_toggle,
    stale_results,
    suggest_links,
    view_slice,
)
from vicinity.schema import Options


def test_links_mark_results_and_a_note_is_not_its_own(spark, table):
    """Links count from the asking note only, however often they are there; own chunks never."""
    index = chunks_of(
        spark, ("pie.md", 0, [4, 3]), ("pie.md", 1, [4, 3]), ("tart.md", 0, [3, 4]), ("soup.md", 0, [0, 2]),
        ("soup.md", 1, [-1, 0]),
    )
    links = table("src string, dst string", ("pie.md", "soup.md"), ("pie.md", "soup.md"), ("tart.md", "pie.md"))
    got = {(r.source_path, r.rank): r for r in related_notes(index, links=links).collect()}
    told = {k: (r.path, r.is_linked, round(r.similarity, 2), r.chunk_index) for k, r in got.items()}
    assert told == {
        ("pie.md", 1): ("tart.md", False, 0.96, 0), ("pie.md", 2): ("soup.md", True, 0.6, 0),
        ("tart.md", 1): ("pie.md", True, 0.96, 0), ("tart.md", 2): ("soup.md", False, 0.8, 0),
        ("soup.md", 1): ("tart.md", False, 0.8, 0), ("soup.md", 2): ("pie.md", False, 0.6, 0),
    }
    first = got["tart.md", 1]
    assert (first.title, first.similar_chunk, first.source_chunk) == ("title pie.md", "pie.md#0", "tart.md#0")


def test_cut_per_chunk_comes_before_pooling(spark, table):
    """Fifteen chunks, not notes: many chunks of one target crowd out the others."""
    index = chunks_of(
        spark,
        ("s.md", 0, [1, 0]),
        *[("many.md", i, [1, 0.01 * i]) for i in range(20)],
        ("far.md", 0, [1, 0.5]),
    )
    sources = table("path string", ("s.md",))
    assert [r.path for r in related_notes(index, sources, texts=False).collect()] == ["many.md"]
    wide = related_notes(index, sources, k=21, texts=False).orderBy("rank").collect()
    assert [r.path for r in wide] == ["many.md", "far.md"]


def test_ties_go_to_the_earlier_chunks(table):
    hits = table(
        "source_path string, source_chunk_index int, path string, chunk_index int, score double",
        ("s", 1, "b", 0, 0.9), ("s", 0, "b", 2, 0.9), ("s", 0, "b", 1, 0.9), ("s", 0, "a", 3, 0.9),
        ("s", 0, "c", 0, 0.95), ("s", 1, "c", 0, 0.2),
    )
    got = rank_targets(best_pairs(hits), 2).orderBy("rank").collect()
    assert [(r.path, r.source_chunk_index, r.chunk_index, r.similarity) for r in got] == [
        ("c", 0, 0, 0.95), ("a", 0, 3, 0.9)]
    third = [r for r in best_pairs(hits).collect() if r.path == "b"][0]
    assert (third.source_chunk_index, third.chunk_index) == (0, 1)


RESULTS = "source_path string, path string, title string, similarity double, source_chunk string, rank int"


def test_result_steps(table):
    results = table(RESULTS, ("s", "a.md", "A", 0.9, "x", 1), ("s", "b.md", "B", 0.55, "y", 2),
                    ("s", "c.md", "C", 0.2, "z", 3), ("s", "s", "S", 1.0, "w", 4))
    assert {r.path for r in exclude_self(results).collect()} == {"a.md", "b.md", "c.md"}
    listed = table("source_path string, path string", ("s", "a.md"), ("t", "b.md"))
    assert {r.path for r in exclude_self(results, listed).collect()} == {"b.md", "c.md", "s"}
    results = exclude_self(results)
    assert [r.path for r in min_similarity(results, 0.6).collect()] == ["a.md"]
    assert min_similarity(results, 0.55).count() == 2 and min_similarity(results).count() == 3
    notes = table("path string", ("a.md",), ("c.md",))
    assert {r.path for r in drop_stale(results, notes).collect()} == {"a.md", "c.md"}
    assert {r.path for r in stale_results(results, notes).collect()} == {"b.md"}
    assert {r.source_chunk for r in source_chunk_toggle(results, False).collect()} == {None}
    assert {r.source_chunk for r in source_chunk_toggle(results, True).collect()} == {"x", "y", "z"}
    links = table("src string, dst string", ("s", "b.md"))
    assert {r.path: r.is_linked for r in flag_linked(results, links).collect()} == {
        "a.md": False, "b.md": True, "c.md": False}


def test_display_names(table):
    results = table(RESULTS, ("s", "x/a.md", "A1", 0.9, "", 1), ("s", "y/a.md", "A2", 0.8, "", 2),
                    ("s", "b.md", "B", 0.7, "", 3), ("t", "x/a.md", "A1", 0.9, "", 1))
    def names(mode):
        return sorted(r.display_name for r in display_name(results, mode).collect())
    assert names("smart") == ["A1", "B", "x/a", "y/a"]
    assert names("title") == ["A1", "A1", "A2", "B"]
    assert names("path") == ["b.md", "x/a.md", "x/a.md", "y/a.md"]


def test_recommend_and_views_do_not_backfill(spark, table):
    index = chunks_of(spark, ("s.md", 0, [1, 0]), *[(f"n{i}.md", 0, [1, 0.1 * i]) for i in range(1, 9)])
    options = Options(sidebar_count=4, bottom_count=2, min_similarity=0.93)
    notes = table("path string", *[(f"n{i}.md",) for i in range(2, 9)])
    links = table("src string, dst string", ("s.md", "n2.md"))
    found = recommend(index, notes, links, options, table("path string", ("s.md",)))
    assert sorted(r.path for r in found.collect()) == ["n2.md", "n3.md", "n4.md"]
    assert {r.source_chunk for r in found.collect()} == {None}
    shown = view_slice(found, "bottom", options).orderBy("position").collect()
    assert [(r.path, r.position) for r in shown] == [("n2.md", 1), ("n3.md", 2)]
    assert view_slice(found, "sidebar", options).count() == 2


EMBEDDER = HashEmbedder(64, max_tokens=8)


def indexed(spark, *items):
    notes = notes_of(spark, *items).select("path", "title", "content").withColumn("chunk_index", F.lit(0))
    return embed_column(notes, "content", EMBEDDER).drop("error")


def test_text_search(spark, table):
    index = indexed(spark, ("red.md", "red apple"), ("blue.md", "blue sky"), ("mix.md", "red sky"))
    queries = table("query_id string, text string", ("q1", "red apple"), ("q2", "red apple and much else besides"))
    got = search_text(queries, index, EMBEDDER, limit=2).collect()
    first = {r.query_id: r for r in got if r["rank"] == 1}
    assert first["q1"].path == "red.md" and first["q1"].similarity == pytest.approx(1.0)
    assert (first["q1"].token_count, first["q1"].max_tokens, first["q1"].is_over_limit) == (5, 8, False)
    assert first["q2"].is_over_limit and first["q2"].source_chunk.endswith("besides")
    assert all(r.similar_chunk for r in got)
    notes = table("path string, title string", ("red.md", "Red"))
    links = suggest_links(queries.union(table("query_id string, text string", ("q3", ""))), index, notes, EMBEDDER)
    assert {(r.query_id, r.link) for r in links.collect()} == {("q1", "[[Red]]"), ("q2", "[[Red]]")}


def test_best_chunk_per_note_among_three_times_the_limit(spark, table):
    index = chunks_of(spark, *[("a.md", i, [1, 0.001 * i]) for i in range(3)], ("b.md", 0, [1, 1]))
    queries = spark.createDataFrame([("q", "t", [1.0, 0.0])], "query_id string, text string, embedding array<float>")
    assert [r.path for r in search_text(queries, index, limit=1).collect()] == ["a.md"]
    got = search_text(queries, index, limit=2).orderBy("rank").collect()
    assert [(r.path, r.chunk_index) for r in got] == [("a.md", 0), ("b.md", 0)]


class Picky(HashEmbedder):
    def embed_texts(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("bad text")
        return super().embed_texts(texts)


def test_fresh_notes(spark, table):
    index = indexed(spark, ("red.md", "red apple"), ("blue.md", "blue sky"))
    notes = notes_of(spark, ("new.md", "a red apple tree"), ("red.md", "red apple"), ("bad.md", "poison red"),
                     ("empty.md", ""))
    fresh = fresh_chunks(notes, index, Picky(64))
    assert {r.path for r in fresh.select("path").collect()} == {"new.md"}
    got = related_notes(index, fresh, fresh=fresh, limit=1).collect()
    assert [(r.source_path, r.path, r.source_chunk) for r in got] == [("new.md", "red.md", "a red apple tree")]
