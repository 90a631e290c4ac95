import os
import re
import threading

import pytest
from pyspark.sql import functions as F
from tests.util import chunks_of, notes_of

from vicinity.functions.regexes import RegexDialectError
from vicinity.functions.text import exclude_content
from vicinity.operators.embedding import HashEmbedder
from vicinity.operators.index import (
    count_chunks,
    delete_notes,
    get_by_path,
    index_notes,
    lookup_paths,
    other_paths,
    rebuild_changes,
    rebuild_index,
    removed_counts,
    rename_notes,
    stamp,
    upsert_notes,
)
from vicinity.operators.state import clear_state, count_state, drop_state, get_state, set_errored, set_state
from vicinity.schema import CHANGES, ERRORED, INDEX, STATE, Options, columns
from vicinity.sources import tables
from vicinity.sources.tables import (
    overwrite_index,
    read_current,
    read_index,
    read_paths,
    write_change,
    write_index,
    writing,
)

AT = "2024-01-01 00:00:00"


def keys(df):
    return {(r.path, r.chunk_index) for r in df.select("path", "chunk_index").collect()}


def small(spark):
    return stamp(chunks_of(spark, ("a.md", 0, [1]), ("a.md", 1, [2]), ("b.md", 0, [3])), AT)


def test_upsert_replaces_whole_notes(spark):
    new = stamp(chunks_of(spark, ("a.md", 0, [9]), ("c.md", 0, [9])), AT)
    got = upsert_notes(small(spark), new)
    assert keys(got) == {("a.md", 0), ("b.md", 0), ("c.md", 0)}
    assert got.filter("path = 'a.md'").first().embedding == [9.0]


def test_delete_and_counts(spark, table):
    paths = table("path string", ("a.md",), ("no.md",))
    assert keys(delete_notes(small(spark), paths)) == {("b.md", 0)}
    assert {tuple(r) for r in removed_counts(small(spark), paths).collect()} == {
        ("a.md", 2, True), ("no.md", 0, False)}
    assert count_chunks(small(spark)).first().chunks == 3
    assert keys(get_by_path(small(spark), "a.md")) == {("a.md", 0), ("a.md", 1)}
    assert get_by_path(small(spark), "zz").count() == 0


def test_rename_keeps_vectors_and_titles(spark, table):
    renames = table("old_path string, path string", ("a.md", "x/new.md"), ("no.md", "y.md"))
    got, unmatched = rename_notes(small(spark), renames, "2025-01-01 00:00:00")
    assert keys(got) == {("x/new.md", 0), ("x/new.md", 1), ("b.md", 0)}
    row = got.filter("path = 'x/new.md' and chunk_index = 1").first()
    assert row.embedding == [2.0] and row.title == "title a.md"
    assert row.path_hash == __import__("hashlib").sha256(b"x/new.md").hexdigest()
    assert row.last_updated.year == 2025
    assert got.filter("path = 'b.md'").first().last_updated.year == 2024
    assert [r.path for r in unmatched.collect()] == ["y.md"]


def test_index_notes(spark, table):
    notes = notes_of(spark, ("a.md", "---\nk: v\n---\nhello %%secret%% world"), ("b.md", "%%all%%"), ("c.md", ""),
                     ("d.md", "unchanged"))
    changes = table(CHANGES, *[(p, r, 1, None, None) for p, r in
                               (("a.md", "new"), ("b.md", "modified"), ("c.md", "new"), ("d.md", "deleted"))])
    options = Options(exclude_regexes=("%%.*?%%", "(bad"))
    got = index_notes(notes, HashEmbedder(16), options, changes).collect()
    assert [(r.path, r.content, r.error) for r in got] == [("a.md", "hello  world", None)]
    text = "a\n\nhello  world"
    assert got[0].embedding == pytest.approx(HashEmbedder(16).embed_texts([text])[0].tolist())
    kept = index_notes(notes, HashEmbedder(16), Options(include_frontmatter=True), changes)
    assert kept.filter("path = 'a.md'").first().content.startswith("---")
    with pytest.raises(RegexDialectError):
        exclude_content("content", ["(bad"], strict=True)


def test_rebuild(spark):
    notes = notes_of(spark, ("a.md", "x"), ("Archive/b.md", "y"), ("c.png", "z"))
    assert [r.path for r in rebuild_changes(notes).collect()] == ["a.md"]
    got = rebuild_index(notes.filter("path <> 'c.png'"), HashEmbedder(8), at=AT)
    assert got.columns == columns(INDEX) and keys(got) == {("a.md", 0)}


def test_write_and_read(spark, table, tmp_path):
    root = str(tmp_path / "index")
    assert read_index(spark, root).count() == 0
    write_index(small(spark), root, buckets=4)
    assert keys(read_index(spark, root)) == {("a.md", 0), ("a.md", 1), ("b.md", 0)}
    write_index(stamp(chunks_of(spark, ("a.md", 0, [7]))), root, table("path string", ("b.md",), ("no.md",)))
    got = read_index(spark, root)
    assert keys(got) == {("a.md", 0)} and got.first().embedding == [7.0]
    assert got.columns == columns(INDEX)
    write_index(small(spark).limit(0), root)
    assert keys(read_index(spark, root)) == {("a.md", 0)}
    write_index(stamp(chunks_of(spark, ("b.md", 3, [1]))), root)
    assert keys(read_index(spark, root)) == {("a.md", 0), ("b.md", 3)}
    write_index(small(spark).limit(0), root, table("path string", ("a.md",)))
    assert keys(read_index(spark, root)) == {("b.md", 3)}
    overwrite_index(stamp(chunks_of(spark, ("z.md", 0, [1]))), root)
    assert keys(read_index(spark, root)) == {("z.md", 0)}
    assert tables.bucket_count(spark, root, 9) == 4
    assert sorted(n for n in os.listdir(root) if n[0] not in ".") == ["_buckets", "index"]


def test_unusable_vectors_are_not_stored(spark, tmp_path):
    chunks = chunks_of(spark, ("a.md", 0, [1, 2]), ("a.md", 1, None), ("b.md", 0, []), ("c.md", 0, [1]))
    write_index(chunks, str(tmp_path / "a"), dim=2)
    assert keys(read_index(spark, str(tmp_path / "a"))) == {("a.md", 0)}
    overwrite_index(chunks, str(tmp_path / "a"))
    assert keys(read_index(spark, str(tmp_path / "a"))) == {("a.md", 0), ("c.md", 0)}


def test_many_chunks_and_widths(spark, tmp_path):
    root = str(tmp_path / "index")
    chunks = spark.range(1000).select(
        F.concat(F.lit("n"), (F.col("id") % 10).cast("string")).alias("path"), F.lit("t").alias("title"),
        F.lit("c").alias("content"), F.floor(F.col("id") / 10).cast("int").alias("chunk_index"),
        F.lit(100).alias("total_chunks"), F.array_repeat(F.lit(0.1).cast("float"), 768).alias("embedding"))
    write_index(chunks, root)
    got = read_index(spark, root)
    assert got.count() == 1000 and got.first().embedding == pytest.approx([0.1] * 768)
    assert get_by_path(got, "n3").count() == 100


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", range(10))
def test_a_writer_that_dies_between_any_two_writes(spark, table, tmp_path, monkeypatch, step):
    root = str(tmp_path / "index")
    write_index(small(spark), root, buckets=3)
    rows = stamp(chunks_of(spark, ("a.md", 0, [5]), ("d.md", 0, [1])), AT).select(*columns(INDEX))
    change = {"index": (INDEX, rows, table("path string", ("b.md",))), "state": (STATE, table(STATE, ("a.md", 9)), None)}
    done = []

    def dies(name):
        real = getattr(tables, name)

        def run(*args):
            done.append(name)
            if len(done) > step:
                raise Killed
            return real(*args)

        monkeypatch.setattr(tables, name, run)

    for name in ("_bucketed", "finish", "_publish"):
        dies(name)
    # look for what is left, stage four times (old rows stay beside new ones), end, three tables in place
    if step == 9:
        write_change(spark, root, change, stream="s", batch=1)
    else:
        with pytest.raises(Killed):
            write_change(spark, root, change, stream="s", batch=1)
    assert len(done) == min(step + 1, 9)
    monkeypatch.undo()
    before, after = {("a.md", 0), ("a.md", 1), ("b.md", 0)}, {("a.md", 0), ("d.md", 0)}
    if step < 6:
        assert keys(read_index(spark, root)) == before and read_current(spark, root, "state", STATE).count() == 0
    # another writer comes first, then the batch runs again
    write_index(stamp(chunks_of(spark, ("c.md", 0, [1]))), root)
    assert keys(read_index(spark, root)) == {("c.md", 0)} | (after if step >= 5 else before)
    write_change(spark, root, change, stream="s", batch=1)
    assert keys(read_index(spark, root)) == {("c.md", 0)} | after
    assert [tuple(r) for r in read_current(spark, root, "state", STATE).collect()] == [("a.md", 9)]
    # a batch that is stored changes nothing any more
    write_change(spark, root, {"index": (INDEX, rows.limit(0), rows.select("path"))}, stream="s", batch=1)
    assert keys(read_index(spark, root)) == {("c.md", 0)} | after


def test_four_writers_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path / "index"), []

    def write(number):
        try:
            for turn in range(2):
                write_index(stamp(chunks_of(spark, (f"{number}.md", turn, [1]), ("all.md", number, [1]))), root, buckets=2)
        except Exception as err:  # noqa: BLE001
            errors.append(err)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = keys(read_index(spark, root))
    assert not errors and {(f"{n}.md", 1) for n in range(4)} <= got and len(got) == 5
    assert read_index(spark, root).count() == 5


def test_another_driver_is_waited_for(spark, tmp_path):
    root = tmp_path / "index"
    root.mkdir()
    with writing(spark, str(root), "stream"):
        (root / "_writer").rename(root / "kept")
    (root / "kept").rename(root / "_writer")
    with pytest.raises(TimeoutError, match="_writer"), writing(spark, str(root), "other", patience=0.2):
        pass
    with writing(spark, str(root), "stream", patience=0.2):  # its own, from before it died
        assert (root / "_writer").exists()
    assert not (root / "_writer").exists()


def test_an_index_keeps_its_width(spark, tmp_path):
    root = str(tmp_path / "index")
    write_index(stamp(chunks_of(spark, ("a.md", 0, [1, 2]))), root)
    write_index(stamp(chunks_of(spark, ("b.md", 0, [1, 2, 3]), ("c.md", 0, [3, 4]))), root)
    assert keys(read_index(spark, root)) == {("a.md", 0), ("c.md", 0)}


def test_a_lookup_opens_one_bucket(spark, table, tmp_path):
    root = str(tmp_path / "index")
    write_index(small(spark), root, buckets=50)
    got = read_paths(spark, root, "index", INDEX, table("path string", ("a.md",)))
    assert keys(got) == {("a.md", 0), ("a.md", 1)}
    one = spark.range(1).select(tables.bucket_of(F.lit("a.md"), 50)).first()[0]
    plan = got.select("chunk_index")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = (\d+)\)", plan)[1] == str(one)
    assert "EqualTo(path,a.md)" in plan and "embedding" not in plan.split("ReadSchema")[-1]


def test_few_paths_become_a_filter(spark, table, tmp_path):
    root = str(tmp_path / "index")
    write_index(small(spark), root)
    write_index(stamp(chunks_of(spark, ("c.md", 0, [1]))), root)
    paths = table("path string", ("a.md",), ("c.md",), ("no.md",), ("a.md",))
    for few in (3, 2):
        for got in (lookup_paths(read_index(spark, root), paths, few), read_paths(spark, root, "index", INDEX, paths, few)):
            assert keys(got) == {("a.md", 0), ("a.md", 1), ("c.md", 0)}
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("In(path" in plan) == (few == 3)
    assert lookup_paths(read_index(spark, root), paths.limit(0)).count() == 0
    assert read_paths(spark, root, "index", INDEX, paths.limit(0)).count() == 0


def test_changes_of_nearly_all_paths_shuffle_no_contents(spark, table):
    held = table("path string, content string", *((p, f"text {p}") for p in "abcdef"), (None, "no path"))
    some = table("path string", *((p,) for p in "abcd"), (None,))
    for few, joins in ((5, False), (2, False), (1, True)):
        wanted, others = lookup_paths(held, some, few), other_paths(held, some, few)
        assert {r.path for r in wanted.collect()} == set("abcd")
        assert {r.path for r in others.collect()} == {None, "e", "f"}
        for got in (wanted, others):
            assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == joins
    assert {r.path for r in other_paths(held, some.limit(0), 1).collect()} == {None, *"abcdef"}
    assert {r.path for r in other_paths(held, held, 1).collect()} == {None}


def test_reused_vectors_split_the_notes_once(spark):
    class Counting(HashEmbedder):
        def embed_texts(self, texts):
            if any("kept" in t for t in texts):
                raise RuntimeError("asked again")
            return super().embed_texts(texts)

    options, first = Options(chunk_size=8, chunk_overlap=2), HashEmbedder(4, max_tokens=8)
    old = stamp(index_notes(notes_of(spark, ("a.md", "kept one"), ("b.md", "old text")), first, options), AT)
    notes = notes_of(spark, ("a.md", "kept one"), ("b.md", "new text"), ("c.md", "more text"))
    got = index_notes(notes, Counting(4, max_tokens=8), options, stored=old)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # twice for what is stored, and once each to split and embed
    found = {(r.path, r.chunk_index): (r.content, r.embedding, r.error) for r in got.collect()}
    fresh = index_notes(notes, first, options).collect()
    assert found == {(r.path, r.chunk_index): (r.content, r.embedding, None) for r in fresh}


def test_state_tables(spark, table):
    state = table(STATE, ("a", 1), ("b", 2))
    got = set_state(state, table(STATE, ("b", 3), ("c", 4)))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in drop_state(got, table("path string", ("a",), ("x",))).collect()} == {("b", 3), ("c", 4)}
    assert {tuple(r) for r in get_state(state, table("path string", ("a",), ("x",))).collect()} == {("a", 1), ("x", None)}
    assert clear_state(state).count() == 0 and count_state(state).first().n == 2
    errored = set_errored(table(ERRORED), table("path string, error string, attempts int, mtime bigint", ("a", "e", 1, None)), AT)
    row = errored.first()
    assert (row.path, row.error, row.attempts, row.mtime, row.last_tried_at.year) == ("a", "e", 1, None, 2024)
