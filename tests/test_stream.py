import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vicinity.operators.changes import diff_snapshot
from vicinity.operators.embedding import HashEmbedder
from vicinity.plans.feed import r1_stream
from vicinity.schema import CHANGES, ERRORED, EVENTS, NOTES, STATE, Options
from vicinity.operators.index import index_notes, rebuild_index
from vicinity.sources.tables import BATCHES, overwrite_index, read_current, read_index, write_index
from vicinity.streaming.feed import (
    change_stream,
    coalesce_changes,
    debounce,
    filter_events,
    parse_events,
    settled_events,
)
from vicinity.streaming.indexer import (
    TABLES,
    apply_changes,
    events_to_changes,
    index_stream,
    reconcile,
    retry_waiting,
)


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def events(spark, *items):
    """``(second, seq, kind, path[, old_path[, mtime]])``"""
    rows = [(at(i[0]), i[1], i[2], i[3], i[4] if len(i) > 4 else None, i[5] if len(i) > 5 else i[1]) for i in items]
    return spark.createDataFrame(rows, EVENTS)


def test_filter(spark):
    got = filter_events(events(spark, (0, 1, "create", "a.md"), (0, 2, "create", "a.png"),
                               (0, 3, "modify", "Archive/a.md"), (0, 4, "delete", "Archive/a.md"),
                               (0, 5, "rename", "Archive/b.md", "b.md")), ["Archive/"])
    assert {r.seq for r in got.collect()} == {1, 4, 5}


def test_messages(spark, table):
    raw = table("value string", ('{"ts":"2024-01-01T00:00:05Z","seq":3,"kind":"create","path":"a.md","mtime":9}',),
                ("no json",), ("{}",))
    got = parse_events(raw).collect()
    assert [(r.seq, r.kind, r.path, r.old_path, r.mtime, r.ts) for r in got] == [(3, "create", "a.md", None, 9, at(5))]
    assert parse_events(raw.selectExpr("cast(value as binary) as value")).count() == 1


def test_debounce(spark):
    edits = events(spark, (0, 1, "modify", "a.md"), (1, 2, "modify", "a.md"), (2, 3, "modify", "a.md"),
                   (5, 4, "modify", "a.md"), (0, 5, "modify", "b.md"))
    got = {(r.path, r.seq, r.edits) for r in debounce(edits, "1 second").collect()}
    assert got == {("a.md", 3, 3), ("a.md", 4, 1), ("b.md", 5, 1)}
    assert debounce(edits, "0 seconds").count() == 5
    mixed = edits.union(events(spark, (9, 9, "delete", "a.md")))
    assert {(r.kind, r.seq) for r in settled_events(mixed).collect()} == {
        ("modify", 3), ("modify", 4), ("modify", 5), ("delete", 9)}


def test_last_change_per_path(spark):
    got = coalesce_changes(events(
        spark, (0, 1, "create", "a.md"), (1, 2, "modify", "a.md"), (1, 3, "delete", "a.md"),
        (0, 4, "modify", "old.md"), (2, 5, "rename", "new.md", "old.md"), (1, 6, "modify", "new.md"),
        (0, 7, "rename", "y.md", "x.md"), (3, 8, "create", "x.md")))
    assert {(r.path, r.kind, r.seq) for r in got.collect()} == {
        ("a.md", "delete", 3), ("new.md", "rename", 5), ("y.md", "rename", 7), ("x.md", "create", 8)}


def test_rename_chains_and_reuse_of_a_path(spark, table):
    state = table(STATE, ("a.md", 5), ("x.md", 7))
    got = events_to_changes(events(
        spark, (0, 1, "rename", "b.md", "a.md", 5), (1, 2, "rename", "c.md", "b.md", 5),
        (2, 3, "rename", "y.md", "x.md", 7), (3, 4, "create", "x.md", None, 9)), state)
    assert {(r.path, r.reason, r.mtime, r.old_path) for r in got.collect()} == {
        ("a.md", "deleted", None, None), ("b.md", "deleted", None, None), ("c.md", "new", 5, None),
        ("y.md", "renamed", 7, "x.md"), ("x.md", "new", 9, None)}


class Flaky(HashEmbedder):
    """Fails on texts that name a missing file marker."""

    def __init__(self, marker):
        super().__init__(16)
        self.marker = marker

    def __getstate__(self):
        return {**super().__getstate__(), "marker": self.marker}

    def embed_texts(self, texts):
        if any("poison" in t for t in texts) and not os.path.exists(self.marker):
            raise RuntimeError("model refused")
        return super().embed_texts(texts)


def view(spark, root):
    return {
        "index": {(r.path, r.content) for r in read_index(spark, root).collect()},
        **{t: {tuple(r)[:2] for r in read_current(spark, root, t, TABLES[t]).collect()}
           for t in ("state", "errored")},
        "retry": {(r.path, r.attempts) for r in read_current(spark, root, "retry", CHANGES).collect()},
    }


def changes(spark, *items):
    """``(path, reason, mtime[, old_path])``"""
    return spark.createDataFrame(
        [(i[0], i[1], i[2], i[3] if len(i) > 3 else None, None) for i in items], CHANGES)


def notes(spark, **texts):
    return spark.createDataFrame([(f"{n}.md", n, t, 1) for n, t in texts.items()], NOTES)


def test_changes_are_applied(spark, tmp_path):
    root, embedder = str(tmp_path / "root"), Flaky(str(tmp_path / "cured"))
    corpus = notes(spark, a="apple", b="banana", p="poison", e="")
    apply_changes(spark, changes(spark, ("a.md", "new", 1), ("b.md", "new", 1), ("p.md", "new", 4), ("e.md", "new", 1)),
                  root, corpus, embedder)
    assert view(spark, root) == {
        "index": {("a.md", "apple"), ("b.md", "banana")},
        "state": {("a.md", 1), ("b.md", 1), ("e.md", 1)},  # the empty note counts as processed
        "errored": set(), "retry": {("p.md", 1)}}
    # a failure is not recorded as indexed, so a diff finds the note again
    todo = diff_snapshot(corpus, read_current(spark, root, "state", STATE), spark.createDataFrame([], ERRORED))
    assert [r.path for r in todo.collect()] == ["p.md"]

    corpus = notes(spark, a="apple two", b="banana", p="poison", moved="banana")
    apply_changes(spark, changes(spark, ("a.md", "modified", 2), ("moved.md", "renamed", 1, "b.md")), root, corpus, embedder, stream="s", batch=7)
    got = view(spark, root)
    assert got["index"] == {("a.md", "apple two"), ("moved.md", "banana")}
    assert got["state"] == {("a.md", 2), ("moved.md", 1), ("e.md", 1)} and got["retry"] == {("p.md", 2)}

    apply_changes(spark, changes(spark, ("e.md", "deleted", None)), root, corpus, embedder, stream="s", batch=8)
    got = view(spark, root)
    assert got["errored"] == {("p.md", "model refused")} and got["retry"] == set()
    assert got["state"] == {("a.md", 2), ("moved.md", 1)}
    before = got
    # the same batch again changes nothing
    apply_changes(spark, changes(spark, ("a.md", "deleted", None)), root, corpus, embedder, stream="s", batch=8)
    assert view(spark, root) == before

    open(embedder.marker, "w").close()
    apply_changes(spark, changes(spark, ("p.md", "modified", 5), ("fresh.md", "renamed", 3, "never.md")), root,
                  notes(spark, p="poison", fresh="fig"), embedder)
    got = view(spark, root)
    assert got["errored"] == set() and ("p.md", "poison") in got["index"] and ("fresh.md", "fig") in got["index"]
    assert ("fresh.md", 3) in got["state"]


def test_reconcile_and_retry_without_events(spark, tmp_path):
    root, embedder = str(tmp_path / "root"), Flaky(str(tmp_path / "cured"))
    corpus = notes(spark, a="apple", p="poison")
    reconcile(spark, root, corpus, embedder)
    assert view(spark, root)["index"] == {("a.md", "apple")} and view(spark, root)["retry"] == {("p.md", 1)}
    open(embedder.marker, "w").close()
    retry_waiting(spark, root, corpus, embedder)
    got = view(spark, root)
    assert got["index"] == {("a.md", "apple"), ("p.md", "poison")} and got["retry"] == set()
    retry_waiting(spark, root, corpus, embedder)
    assert view(spark, root) == got
    reconcile(spark, root, notes(spark, p="poison"), embedder)
    assert view(spark, root)["state"] == {("p.md", 1)} and view(spark, root)["index"] == {("p.md", "poison")}


@pytest.mark.parametrize("on_empty, left", [("keep", {("a.md", "apple")}), ("delete", set())])
def test_emptied_notes(spark, tmp_path, on_empty, left):
    root, options = str(tmp_path / "root"), Options(on_empty=on_empty)
    embedder = HashEmbedder(8)
    apply_changes(spark, changes(spark, ("a.md", "new", 1)), root, notes(spark, a="apple"), embedder, options)
    apply_changes(spark, changes(spark, ("a.md", "modified", 2)), root, notes(spark, a=""), embedder, options)
    got = view(spark, root)
    assert got["index"] == left and got["state"] == {("a.md", 2)}


def test_stream_to_index(spark, tmp_path):
    src, root = tmp_path / "events", str(tmp_path / "root")
    src.mkdir()

    def feed(number, *items):
        events(spark, *items).coalesce(1).write.mode("append").parquet(str(src / f"batch{number}"))
        for file in (src / f"batch{number}").glob("*.parquet"):
            os.link(file, src / f"{number}.parquet")

    contents, checkpoints = {"a": "apple", "b": "banana"}, ["cp"]

    def run():
        stream = change_stream(spark, str(src / "*.parquet"), patterns=["Archive/"], max_files_per_trigger=1)
        job = index_stream(stream, root, lambda: notes(spark, **contents), HashEmbedder(8), str(tmp_path / checkpoints[-1]),
                           Options(exclude_globs=("Archive/",)), {"availableNow": True})
        job.awaitTermination()

    feed(1, (0, 1, "create", "a.md"), (1, 2, "modify", "b.md"), (1, 3, "create", "x.png"))
    run()
    assert {p for p, _ in view(spark, root)["index"]} == {"a.md", "b.md"}
    contents["c"] = "banana"
    feed(2, (10, 4, "rename", "c.md", "b.md", 2))
    feed(3, (11, 5, "delete", "a.md"))
    run()
    got = view(spark, root)
    assert got["index"] == {("c.md", "banana")} and got["state"] == {("c.md", 2)}
    moved = read_index(spark, root).first()
    assert moved.title == "b"  # the title travels with the chunks
    assert [r.mtime for r in read_current(spark, root, "batches", BATCHES).collect()] == [2]
    # what else is written in between, or a new checkpoint, never makes a batch look done
    overwrite_index(rebuild_index(notes(spark, z="zebra"), HashEmbedder(8)), root)
    for _ in range(3):
        write_index(index_notes(notes(spark, y="yak"), HashEmbedder(8)).drop("error"), root)
    contents["d"] = "date"
    feed(4, (20, 6, "create", "d.md", None, 9), (20, 7, "create", "Archive/q.md"))
    run()
    assert {p for p, _ in view(spark, root)["index"]} == {"z.md", "y.md", "d.md"}
    checkpoints.append("other")
    run()
    assert {p for p, _ in view(spark, root)["index"]} == {"z.md", "y.md", "d.md", "c.md"}


def test_debounce_as_a_stream_emits_rows_of_the_batch_answer(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    items = [(s, n, "modify", f"{s % 3}.md") for n, s in enumerate(list(range(0, 30)) + list(range(100, 130)) + [400])]
    data = events(spark, *items)
    for part in (data.filter(F.col("seq") < 40), data.filter(F.col("seq") >= 40)):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = debounce(change_stream(spark, src, max_files_per_trigger=1), "10 seconds", "20 seconds")
    job = (stream.writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    job.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()}
    want = {tuple(r) for r in debounce(data, "10 seconds").collect()}
    assert got and got <= want


def test_the_retry_query_keeps_a_document_numbered_zero(spark, tmp_path):
    rows = [(0, "x", "fr", "s", 1), (1, "y", "de", "s", 1), (-1, "z", "en", "s", 1), (2, "w", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.path: (r.mtime, r.attempts) for r in r1_stream(spark, str(tmp_path)).collect()}
    assert found == {"n/0.md": (0, None), "n/1.md": (None, 3), "n/-1.md": (-1, None), "n/2.md": (2, None)}
