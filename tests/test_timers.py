"""What waits in a stream: the rules of one path, and streams whose feed simply ends."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import Row

from vicinity.operators.embedding import HashEmbedder
from vicinity.plans.feed import _until_released
from vicinity.schema import CHANGES, ERRORED, EVENTS, NOTES, STATE, Options, columns
from vicinity.sources.tables import read_current, read_index
from vicinity.streaming.feed import change_stream, debounce
from vicinity.streaming.indexer import index_stream
from vicinity.streaming.timers import NONE, ROW, Waiting, WaitingRows, as_events, bursts, settle, tried_again


class Handle:
    """State and timers of one path in memory."""

    def __init__(self):
        self.row, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None

    def registerTimer(self, due):
        self.timers.add(due)

    def deleteTimer(self, due):
        self.timers.remove(due)


class Path:
    """Plays events of one path and the clock against the rules."""

    def __init__(self, quiet=1000, gap=None, retry=500):
        self.handle, self.rules, self.now = Handle(), Waiting(quiet, gap, retry), 0
        self.rules.init(self.handle)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due

    def _told(self, frames):
        return [(r.kind, r.seq, r.edits) for f in frames for r in f.itertuples()]

    def send(self, *events):
        """``(ts, seq, kind[, attempts])``"""
        rows = [("a.md", e[0], e[1], e[2], None, 7, e[3] if len(e) > 3 else NONE, e[0], 1) for e in events]
        return self._told(self.rules.handleInputRows(("a.md",), iter([pd.DataFrame(rows, columns=columns(ROW))]), self))

    def wait(self, ms):
        self.now += ms
        out = []
        for self.due in sorted(t for t in self.handle.timers if t <= self.now):
            self.handle.timers.remove(self.due)
            out += self._told(self.rules.handleExpiredTimer(("a.md",), self, self))
        return out


def test_an_edit_waits_until_its_path_is_quiet():
    path = Path()
    assert path.send((0, 1, "modify")) == [] and path.wait(900) == []
    assert path.send((5, 2, "modify"), (3, 3, "modify")) == [] and path.wait(999) == []
    assert path.wait(1) == [("modify", 2, 3)] and not path.handle.exists() and not path.handle.timers
    assert path.wait(5000) == []


def test_other_events_pass_and_drop_what_waits():
    for kind in ("delete", "create", "rename"):
        path = Path()
        path.send((0, 1, "modify"))
        assert path.send((1, 2, kind)) == [(kind, 2, 1)] and path.wait(5000) == [] and not path.handle.timers
    path = Path()
    path.send((0, 1, "modify"))
    assert path.send((1, 2, "left")) == [] and path.wait(5000) == []
    # what comes after the rename counts again
    assert path.send((2, 3, "left"), (3, 4, "modify")) == [] and path.wait(1000) == [("modify", 4, 1)]


def test_bursts_end_at_a_gap_too():
    path = Path(gap=10)
    assert path.send((0, 1, "modify"), (10, 2, "modify"), (21, 3, "modify")) == [("modify", 2, 2)]
    assert path.send((5, 4, "modify")) == [("modify", 4, 1)]  # far too late: of its own
    assert path.send((12, 5, "modify")) == [] and path.wait(1000) == [("modify", 3, 2)]


def test_failed_changes_come_back_unless_something_newer_does():
    path = Path()
    assert path.send((0, 0, "modify", 1)) == [] and path.wait(499) == [] and path.wait(1) == [("modify", 0, 1)]
    assert path.send((0, 0, "modify", 2)) == [] and path.wait(999) == [] and path.wait(1) == [("modify", 0, 1)]
    path.send((0, 0, "modify", 1))
    assert path.send((1, 8, "modify")) == [] and path.wait(500) == [] and path.wait(500) == [("modify", 8, 1)]
    path.send((2, 9, "modify"))
    assert path.send((3, 0, "modify", 1)) == [] and path.wait(1000) == [("modify", 9, 1)] and path.wait(9000) == []
    path.send((0, 0, "modify", 1))
    assert path.send((4, 10, "delete")) == [("delete", 10, 1)] and path.wait(9000) == []


def test_no_quiet_time_holds_no_edit():
    assert Path(quiet=0).send((0, 1, "modify"), (0, 2, "modify")) == [("modify", 1, 1), ("modify", 2, 1)]


class RowPath(Path):
    """The same rules on rows."""

    def __init__(self, quiet=1000, gap=None, retry=500):
        super().__init__(quiet, gap, retry)
        self.rules = WaitingRows(quiet, gap, retry)
        self.rules.init(self.handle)

    def _told(self, rows):
        return [(r.kind, r.seq, r.edits) for r in rows]

    def send(self, *events):
        rows = [("a.md", e[0], e[1], e[2], None, 7, e[3] if len(e) > 3 else NONE, e[0], 1) for e in events]
        rows = iter([Row(*columns(ROW))(*r) for r in rows])
        return self._told(self.rules.handleInputRows(("a.md",), rows, self))


@pytest.mark.parametrize("gap", [None, 10])
def test_rows_go_by_the_rules_of_frames(gap):
    steps = [
        [(0, 1, "modify")], [(30, 3, "modify"), (5, 2, "modify")], 900, [(31, 0, "modify", 1)], 2000, [(32, 0, "create", 2)],
        400, [(40, 4, "delete"), (41, 5, "modify")], 1000, [(50, 6, "rename")], [(60, 0, "modify", 1)], [(61, 7, "left")], 5000,
    ]
    told = [[p.wait(s) if isinstance(s, int) else p.send(*s) for s in steps] for p in (Path(gap=gap), RowPath(gap=gap))]
    assert told[0] == told[1] and any(told[0])


class Job:
    """A stream whose batches each take some time; told are its input and its rows of state."""

    isActive, stopped = True, False

    def __init__(self, batches, seconds=0.1):
        self.batches, self.seconds, self.began = batches, seconds, time.monotonic()

    @property
    def recentProgress(self):
        done = min(int((time.monotonic() - self.began) / self.seconds), len(self.batches))
        return [
            Row(batchId=k, numInputRows=n, stateOperators=[Row(numRowsTotal=m)])
            for k, (n, m) in enumerate(self.batches[:done])
        ]

    def stop(self):
        self.stopped = True

    def exception(self):
        return None


def test_a_stream_that_goes_on_may_take_long():
    job = Job([(9, 5), (5, 9), (0, 4), (4, 4), (0, 2), (0, 0), (0, 0)])
    _until_released(job, 0.3)
    assert job.stopped
    # one batch that takes longer than that is no stop either
    _until_released(Job([(9, 5), (0, 0), (0, 0)], 0.4), 0.2)
    job = Job([(9, 5)] + [(0, 5)] * 99)
    with pytest.raises(TimeoutError):
        _until_released(job, 0.3)
    assert job.stopped


def test_failed_changes_keep_what_they_were(spark):
    rows = [("a.md", "new", 3, None, 1), ("b.md", "renamed", 4, "c.md", 2), ("d.md", "modified", None, None, 1)]
    again = tried_again(as_events(spark.createDataFrame(rows, CHANGES)))
    assert {tuple(r) for r in again.collect()} == set(rows)


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def run_until(job, done, seconds=150):
    until = time.monotonic() + seconds
    try:
        while not done():
            assert job.isActive and time.monotonic() < until, job.exception()
            time.sleep(0.3)
    finally:
        job.stop()


def test_what_waits_outlasts_a_restart_and_needs_no_further_event(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [(at(s), n, "modify", f"{s % 3}.md", None, n) for n, s in enumerate([0, 1, 2, 3, 9, 100, 101])]
    data = spark.createDataFrame(rows, EVENTS)
    data.coalesce(1).write.parquet(src)

    def start(quiet):
        found = bursts(settle(change_stream(spark, src), quiet, 20))
        return (found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
                .trigger(processingTime="0 seconds").start())

    schema = "path STRING, first_ts TIMESTAMP, last_ts TIMESTAMP, seq BIGINT, mtime BIGINT, edits BIGINT"

    def done():
        return {tuple(r) for r in spark.read.schema(schema).parquet(out).collect()} if (tmp_path / "out").exists() else set()

    job = start(30)
    run_until(job, lambda: job.lastProgress and job.lastProgress.stateOperators[0].numRowsTotal == 3)
    want = {tuple(r) for r in debounce(data, "20 seconds").collect()}
    assert done() < want
    job = start(1)
    run_until(job, lambda: done() == want)


class Flaky(HashEmbedder):
    """Refuses some texts until it has been asked for a third time."""

    def __init__(self):
        super().__init__(8)
        self.asked = 0

    def __getstate__(self):
        return {**super().__getstate__(), "asked": self.asked}

    def embed_texts(self, texts):
        if any("bad" in t or "slow" in t and self.asked < 3 for t in texts):
            raise RuntimeError("refused")
        return super().embed_texts(texts)


def test_failed_notes_are_tried_again_by_the_stream(spark, tmp_path):
    root, model = str(tmp_path / "root"), Flaky()
    corpus = spark.createDataFrame([(f"{n}.md", n, n, 1) for n in ("fine", "slow", "bad")], NOTES)
    spark.createDataFrame(
        [(at(k), k, "create", f"{n}.md", None, 5) for k, n in enumerate(("fine", "slow", "bad"))], EVENTS
    ).write.parquet(str(tmp_path / "src"))

    def notes():
        model.asked += 1
        return corpus

    job = index_stream(change_stream(spark, str(tmp_path / "src")), root, notes, model, str(tmp_path / "cp"),
                       Options(), {"processingTime": "0 seconds"}, 0.1)
    run_until(job, lambda: read_current(spark, root, "errored", ERRORED).count() == 1)
    assert {r.path for r in read_index(spark, root).collect()} == {"fine.md", "slow.md"}
    assert {tuple(r) for r in read_current(spark, root, "state", STATE).collect()} == {("fine.md", 5), ("slow.md", 5)}
    failed = read_current(spark, root, "errored", ERRORED).first()
    assert (failed.path, failed.attempts) == ("bad.md", 3) and model.asked == 3
    assert read_current(spark, root, "retry", CHANGES).count() == 0
