import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tests.util import rows

from vicinity.operators.reports import (
    estimate_usage,
    index_counts,
    index_status,
    preview_list,
    usage_cost,
    usage_daily,
    usage_retention,
    usage_today,
    usage_total,
    visible_errored,
)
from vicinity.schema import ERRORED, STATE, USAGE
from vicinity.sources.export import export_related, write_export
from vicinity.sources.notes import append_usage, find_notes, read_links, read_notes, read_snapshot, read_usage


def test_status(table):
    """Every path is in one bucket: excluded before errored before indexed, else pending."""
    paths = [f"{folder}/{n}.md" for folder in ("inbox", "work", "old") for n in range(4)]

    def status(globs, indexed, errored, paths=paths):
        return tuple(index_status(
            table("path string", *[(p,) for p in paths]), table(STATE, *[(p, 1) for p in indexed]),
            table(ERRORED, *[(p, "e", 3, 1, None) for p in errored]), globs).first())

    assert status([], paths, []) == (12, 0, 0, 12, 0)
    assert status(["old/"], paths[:6], ["work/2.md", "old/1.md"]) == (12, 4, 1, 6, 1)
    # a failed note counts as such although it is indexed, an excluded one as neither
    assert status(["*/0.md"], ["inbox/0.md", "work/1.md"], ["work/1.md", "work/0.md"]) == (12, 3, 1, 0, 8)
    assert status(["**"], paths, paths) == (12, 12, 0, 0, 0)
    assert status(["old/"], ["gone.md"], ["gone.md"], []) == (0, 0, 0, 0, 0)


def test_visible_errors(table):
    failed = ["drafts/x.md", "drafts/y.md", "log/2024.md", "removed.md"]
    errored = table(ERRORED, *[(p, "e", 3, 1, None) for p in failed])

    def shown(paths, globs):
        return sorted(r.path for r in visible_errored(errored, table("path string", *[(p,) for p in paths]), globs).collect())

    assert shown([*failed, "fine.md"], []) == failed
    assert shown(failed[:3], ["**/y.md", "log/"]) == ["drafts/x.md"]
    assert shown(["fine.md"], []) == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_and_stamps_are_utc(spark, table, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        used = spark.sql(
            "SELECT timestamp_seconds(1704078000 + id * 3600) AS ts, 1L AS tokens FROM range(30)")
        days = {str(r.day): r.request_count for r in usage_daily(used).collect()}
        assert days == {"2024-01-01": 21, "2024-01-02": 9}
        assert usage_total(used).first().first_use_date == "2024-01-01"
        sources = table("source_path string, known boolean", ("a.md", True))
        results = table("source_path string, path string, title string, similarity double, similar_chunk string, "
                        "is_linked boolean, rank int", ("a.md", "b.md", "b", 0.5, "c", False, 1))
        at = F.timestamp_seconds(F.lit(1704078000))
        made = export_related(results, sources, at).first().payload
        assert json.loads(made)["generatedAt"] == "2024-01-01T03:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_counts_and_preview(table):
    one = table("path string", ("a",), ("b",))
    assert tuple(index_counts(one, one.limit(1), one, one.limit(0)).first()) == (1, 2, 2, 0)
    many = table("path string", *[(f"p{i:03}",) for i in range(105)])
    got = preview_list(many).collect()
    assert len(got) == 100 and {r.more for r in got} == {5} and max(r.path for r in got) == "p099"
    assert {r.more for r in preview_list(one).collect()} == {0}


def test_usage(table, spark, tmp_path):
    def at(day, hour=0):
        return dt.datetime(2024, 1, day, hour)
    usage = table(USAGE, (at(1, 23), 10), (at(2), 5), (at(2, 23), 7), (at(31), 1))
    daily = usage_daily(usage)
    assert {(r.day.day, r.tokens, r.request_count) for r in daily.collect()} == {(1, 10, 1), (2, 12, 2), (31, 1, 1)}
    assert tuple(usage_total(usage).first()) == (23, 4, "2024-01-01")
    assert tuple(usage_total(usage.limit(0)).first()) == (0, 0, "")
    # thirty days before the last of January is the first; one day later it is dropped
    assert {r.day.day for r in usage_retention(daily, "2024-01-31").collect()} == {1, 2, 31}
    assert {r.day.day for r in usage_retention(daily, "2024-02-01").collect()} == {2, 31}
    assert tuple(usage_today(daily, "2024-01-02").first()) == (dt.date(2024, 1, 2), 12, 2)
    assert tuple(usage_today(daily, "2024-01-03").first()) == (dt.date(2024, 1, 3), 0, 0)
    root = str(tmp_path / "usage")
    append_usage(usage, root)
    append_usage(usage.limit(1), root)
    assert read_usage(spark, root).count() == 5


def test_cost(spark, table):
    df = table("tokens bigint, price double", (1_000_000, 0.02), (1234, 0.13), (5, None), (5, 0.0), (5, -1.0), (0, 1.0))
    got = [r[0] for r in df.select(usage_cost("tokens", F.col("price"))).collect()]
    assert got == ["~$0.0200", "~$0.0002", None, None, None, "~$0.0000"]
    assert df.select(usage_cost("tokens", None).alias("c")).filter("c is null").count() == 6


def test_estimated_usage(table):
    texts = table("batch int, text string", (1, "abcdefgh"), (1, "é"), (2, ""))
    assert rows(estimate_usage(texts, "batch")) == [(1, 3, 1), (2, 0, 1)]


RESULTS = ("source_path string, path string, title string, similarity double, similar_chunk string, "
           "is_linked boolean, rank int")


def test_export(spark, table, tmp_path):
    results = table(RESULTS, ("S.md", "B.md", "B", 0.5, "chunk-b", False, 2), ("S.md", "A.md", "A", 0.9, "chunk-a", True, 1))
    sources = table("source_path string, known boolean, error string", ("S.md", True, None), ("none.md", True, None),
                    ("gone.md", False, None), ("pic.png", True, None), ("bad.md", True, "no index"))
    docs = export_related(results, sources, "2024-05-06 07:08:09.123")
    got = {r.source_path: json.loads(r.payload) for r in docs.collect()}
    stamp = "2024-05-06T07:08:09.123Z"
    assert got["S.md"] == {
        "version": 1, "ok": True, "sourcePath": "S.md", "generatedAt": stamp,
        "results": [{"path": "A.md", "title": "A", "score": 0.9, "excerpt": "chunk-a", "linked": True},
                    {"path": "B.md", "title": "B", "score": 0.5, "excerpt": "chunk-b", "linked": False}]}
    assert got["none.md"]["ok"] and got["none.md"]["results"] == []
    for path in ("gone.md", "pic.png"):
        assert got[path] == {"version": 1, "ok": False, "code": "NO_ACTIVE_FILE",
                             "error": "No active markdown file", "generatedAt": stamp}
    assert got["bad.md"]["code"] == "SEARCH_FAILED" and got["bad.md"]["error"] == "no index"
    write_export(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_read_notes_from_a_folder(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "sub dir" / "b+c 50%.md").write_text("é")
    (tmp_path / "c.txt").write_text("no")
    got = {r.path: r for r in read_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "sub dir/b+c 50%.md"}
    assert got["a.md"].content == "one\ntwo\n" and got["a.md"].title == "a"
    assert got["sub dir/b+c 50%.md"].title == "b+c 50%"
    assert got["a.md"].mtime == (tmp_path / "a.md").stat().st_mtime_ns // 1_000_000
    shot = {tuple(r) for r in read_snapshot(spark, str(tmp_path)).collect()}
    assert shot == {(r.path, r.mtime) for r in got.values()}


def test_links(spark, table):
    notes = table("path string, title string, content string",
                  ("a.md", "a", "see [[b]], [[b|again]], [[x/c#head]] and [[missing]] and ![[d.md]]"),
                  ("b.md", "b", "[[ a ]]"), ("x/c.md", "c", ""), ("y/b.md", "b", "[[y/b]]"), ("d.md", "d", ""))
    assert rows(read_links(notes)) == [("a.md", "b.md"), ("a.md", "d.md"), ("a.md", "x/c.md"), ("b.md", "a.md"),
                                       ("y/b.md", "y/b.md")]
    pages = table("path string, content string", ("p", '<a href="/x">1</a><a href="/x">2</a><a href="/y">'))
    assert rows(read_links(pages, "html")) == [("p", "/x"), ("p", "/y")]
    found = find_notes(notes, table("path string", ("b.md",), ("zz.md",))).select("path", "title")
    assert rows(found) == [("b.md", "b"), ("zz.md", None)]
