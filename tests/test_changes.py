from pyspark.sql import functions as F
from tests.util import notes_of, rows

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
from vicinity.schema import CHANGES, ERRORED, STATE


def files(spark):
    return notes_of(spark, ("file1.md", "x", 1000), ("file2.md", "x", 2000), ("file3.md", "x", 3000),
                    ("image.png", "x", 4000))


def brief(changes):
    return {r.path: (r.reason, r.mtime) for r in changes.collect()}


def test_snapshot_lists_markdown_only(spark):
    assert {r.path for r in list_snapshot(files(spark)).collect()} == {"file1.md", "file2.md", "file3.md"}


def test_diff(spark, table):
    state = table(STATE, ("file1.md", 1500), ("file2.md", 2000), ("gone.md", 5))
    changes = diff_snapshot(files(spark), state, table(ERRORED))
    assert brief(changes) == {"file1.md": ("modified", 1000), "file3.md": ("new", 3000),
                              "gone.md": ("deleted", None)}
    assert tuple(diff_counts(changes).first()) == (1, 1, 1)
    assert changes.columns == [c.split()[0] for c in CHANGES.split(", ")]
    # not committed: the same again
    assert brief(diff_snapshot(files(spark), state, table(ERRORED))) == brief(changes)


def test_errored_notes_are_skipped_until_edited(spark, table):
    errored = table(ERRORED, ("file1.md", "e", 3, 1000, None), ("file2.md", "e", 3, 1999, None),
                    ("file3.md", "e", 3, None, None))
    got = brief(diff_snapshot(files(spark), table(STATE), errored))
    assert got == {"file2.md": ("new", 2000), "file3.md": ("new", 3000)}
    cleared = cleared_by_diff(files(spark), table(STATE), errored)
    assert {r.path for r in cleared.collect()} == {"file2.md", "file3.md"}
    # a note in the state is not looked up among the failures
    state = table(STATE, ("file1.md", 1))
    assert brief(diff_snapshot(files(spark), state, errored))["file1.md"] == ("modified", 1000)
    assert cleared_by_diff(files(spark), table(STATE, ("file2.md", 1)), errored).count() == 1


def test_exclusions(spark, table):
    state = table(STATE, ("file1.md", 1), ("file2.md", 2000))
    changes = apply_exclusions(files(spark), state, table(ERRORED), ["file1.md"])
    assert brief(changes) == {"file1.md": ("deleted", None), "file3.md": ("new", 3000)}
    assert tuple(preview_exclusions(files(spark), state, table(ERRORED), ["file1.md"]).first()) == (1, 1)


def test_all_and_retry(spark, table):
    assert brief(all_notes_as_changes(files(spark), ["file2.md"])) == {
        "file1.md": ("modified", 1000), "file3.md": ("modified", 3000)}
    errored = table(ERRORED, ("file1.md", "e", 3, 7, None), ("gone.md", "e", 3, 1, None))
    assert brief(retry_errored(errored, files(spark))) == {"file1.md": ("modified", 1000)}


RENAMES = "old_path string, path string, mtime bigint"


def test_renames(table):
    state = table(STATE, ("same.md", 5), ("edited.md", 5), ("hidden.md", 5))
    events = table(RENAMES, ("same.md", "a.md", 5), ("edited.md", "b.md", 6), ("unknown.md", "c.md", 5),
                   ("hidden.md", "Archive/d.md", 5))
    changes = resolve_rename(events, state, ["Archive/"])
    assert rows(changes.select("path", "reason", "mtime", "old_path")) == sorted([
        ("a.md", "renamed", 5, "same.md"),
        ("edited.md", "deleted", None, None), ("b.md", "new", 6, None),
        ("unknown.md", "deleted", None, None), ("c.md", "new", 5, None),
        ("hidden.md", "deleted", None, None)], key=repr)
    after = commit_state(state, changes)
    assert {tuple(r) for r in after.collect()} == {("a.md", 5), ("b.md", 6), ("c.md", 5)}


def test_commit(table):
    state = table(STATE, ("a.md", 1), ("b.md", 1), ("c.md", 1))
    done = table(CHANGES, ("a.md", "modified", 2, None, None), ("b.md", "modified", 0, None, None),
                 ("c.md", "modified", None, None, None), ("d.md", "new", 4, None, None))
    assert {tuple(r) for r in commit_state(state, done).collect()} == {
        ("a.md", 2), ("b.md", 1), ("c.md", 1), ("d.md", 4)}
    errored = table(ERRORED, ("a.md", "e", 3, 1, None), ("z.md", "e", 3, 1, None))
    assert {r.path for r in commit_errored(errored, done).collect()} == {"z.md"}
    edits = table(CHANGES, ("a.md", "deleted", None, None, None), ("z.md", "new", 1, None, None))
    assert {r.path for r in clear_errored(errored, edits).collect()} == {"a.md"}


def test_failures(table):
    outcomes = table(CHANGES + ", error string",
                     ("note.md", "modified", 1234, None, None, "boom"),
                     ("last.md", "modified", 1234, None, 2, "boom"),
                     ("fine.md", "modified", 1, None, 2, None))
    again, dead = route_failures(outcomes, at="2024-01-01 00:00:00")
    assert [(r.path, r.reason, r.mtime, r.attempts) for r in again.collect()] == [
        ("note.md", "modified", 1234, 1)]
    assert [(r.path, r.error, r.attempts, r.mtime) for r in dead.collect()] == [
        ("last.md", "boom", 3, 1234)]
    assert dead.columns == ["path", "error", "attempts", "mtime", "last_tried_at"]


def test_one_failed_chunk_fails_the_note(table):
    made = table("path string, error string", ("a", None), ("a", "x"), ("b", None))
    assert {r.path: (r.ok, r.error) for r in note_outcomes(made).collect()} == {
        "a": (False, "x"), "b": (True, None)}


def test_reuse(table):
    ddl = "path string, title string, content string, chunk_index int"
    index = table(ddl + ", embedding array<float>", ("a", "T", "one", 0, [1.0]), ("a", "T", "two", 1, [2.0]),
                  ("b", "T", "x", 0, [3.0]))
    chunks = table(ddl, ("a", "T", "one", 0), ("a", "T", "TWO", 1), ("b", "New", "x", 0), ("c", "T", "n", 0))
    reused, rest = reuse_embeddings(chunks, index)
    assert [(r.path, r.chunk_index, r.embedding) for r in reused.collect()] == [("a", 0, [1.0])]
    assert {(r.path, r.chunk_index) for r in rest.collect()} == {("a", 1), ("b", 0), ("c", 0)}


def test_significance(table):
    df = table("old string, new string", ("a b", " a \n b "), ("x" * 100, "x" * 101), ("x" * 100, "x" * 102),
               ("abc", "abd"), ("", "abc"))
    got = [r[0] for r in df.select(significant_change(F.col("old"), F.col("new"))).collect()]
    assert got == [False, False, True, False, True]


def test_diff_plan_shuffles_once(spark, table):
    changes = diff_snapshot(files(spark), table(STATE), table(ERRORED), ["a/"])
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
