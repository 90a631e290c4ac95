"""What waits in a stream: edits until their path is quiet, failed changes until their next try.

Each path has a row of keyed state and a timer of processing time, so both survive a restart
and are released when their time has come, whether or not another event follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vicinity.schema import CHANGES, EVENTS, columns

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kind of a row that only says that a rename has left its path.
LEFT = "left"
#: Stands for null in whole numbers, so that they stay whole in Python.
NONE = -(1 << 63)

ROW = (
    "path STRING, ts BIGINT, seq BIGINT, kind STRING, old_path STRING, mtime BIGINT, attempts BIGINT, "
    "first_ts BIGINT, edits BIGINT"
)
_FIELDS = columns(ROW)[1:]
HELD = ", ".join(part for part in ROW.split(", ")[1:]) + ", due BIGINT"
SETTLED = EVENTS + ", attempts INT, first_ts TIMESTAMP, edits BIGINT"


class Waiting(StatefulProcessor):
    """Holds the last edit of a burst, or a change to try again, of one path.

    An edit starts the time of its path anew. Any other event of the path passes at once and
    drops what waits: it is superseded. A failed change is kept for its next try unless
    something newer of its path waits already or comes before.
    """

    def __init__(self, quiet_ms: int, gap_us: int | None, retry_ms: int):
        self.quiet_ms, self.gap_us, self.retry_ms = quiet_ms, gap_us, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues):
        events = [e._asdict() for frame in rows for e in frame[_FIELDS].itertuples(index=False)]
        yield self._frame(key, self._play(events, timerValues.getCurrentProcessingTimeInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._frame(key, self._release(expiredTimerInfo.getExpiryTimeInMs()))

    def _play(self, events, now):
        """What the events of a path give out."""
        before = self._load()
        held, out = before, []
        for event in sorted(events, key=_when):
            new = {**event, "first_ts": event["ts"], "edits": 1, "due": now + self.quiet_ms}
            if event["attempts"] != NONE:
                if held is None:
                    # The wait doubles with each attempt.
                    held = {**new, "due": now + self.retry_ms * 2 ** (event["attempts"] - 1)}
            elif event["kind"] == "modify" and self.quiet_ms > 0:
                held, gone = self._edit(held, new)
                out += gone
            else:
                held = None
                out += [new] if event["kind"] != LEFT else []
        self._keep(before, held)
        return out

    def _release(self, expiry):
        """What a path holds if it is due."""
        held = self._load()
        if held is None or held["due"] > expiry:
            return []
        self.held.clear()
        return [held]

    def _edit(self, held, new):
        """What is held after an edit, and what it releases."""
        if held is None or held["attempts"] != NONE:
            return new, []
        if self.gap_us is not None:
            if new["ts"] - held["ts"] > self.gap_us:
                return new, [held]
            if held["first_ts"] - new["ts"] > self.gap_us:
                # Late by more than the gap: a burst of its own, over long ago.
                return held, [new]
        first, last = min(held, new, key=_when), max(held, new, key=_when)
        return {
            **last, "first_ts": min(first["first_ts"], last["first_ts"]),
            "edits": held["edits"] + new["edits"], "due": new["due"],
        }, []

    def _load(self):
        row = self.held.get() if self.held.exists() else None
        return None if row is None else dict(zip([*_FIELDS, "due"], row))

    def _keep(self, before, held) -> None:
        if held == before:
            return
        if before is not None:
            self.handle.deleteTimer(before["due"])
        if held is None:
            self.held.clear()
        else:
            self.held.update(tuple(None if held[f] is None else held[f] for f in [*_FIELDS, "due"]))
            self.handle.registerTimer(held["due"])

    def _frame(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], *(r[f] for f in _FIELDS)) for r in rows], columns=columns(ROW)
        ).astype({f: "int64" for f in ("ts", "seq", "mtime", "attempts", "first_ts", "edits")})


class WaitingRows(Waiting):
    """The same on rows in place of frames, which take some milliseconds to make for each path."""

    _row = Row(*columns(ROW))

    def handleInputRows(self, key, rows, timerValues):
        events = [{f: row[f] for f in _FIELDS} for row in rows]
        return self._rows(key, self._play(events, timerValues.getCurrentProcessingTimeInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._rows(key, self._release(expiredTimerInfo.getExpiryTimeInMs()))

    def _rows(self, key, found):
        return iter([self._row(key[0], *(r[f] for f in _FIELDS)) for r in found])


def _when(event):
    return event["ts"], event["seq"]


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NONE)).alias(name)


def _rows(events: DataFrame) -> DataFrame:
    """Events as rows of their paths; a rename also tells the path it leaves."""
    attempts = _whole("attempts") if "attempts" in events.columns else F.lit(NONE).alias("attempts")
    flat = events.select(
        "path", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("ts"), _whole("seq"), "kind", "old_path",
        _whole("mtime"), attempts,
    )
    own = F.struct(F.col("path"), F.col("kind"))
    left = F.struct(F.col("old_path").alias("path"), F.lit(LEFT).alias("kind"))
    both = F.when((F.col("kind") == "rename") & F.col("old_path").isNotNull() & (F.col("attempts") == NONE),
                  F.array(own, left)).otherwise(F.array(own))
    return flat.withColumn("at", F.explode(both)).select(
        "at.path", "ts", "seq", "at.kind", "old_path", "mtime", "attempts",
        F.col("ts").alias("first_ts"), F.lit(1).cast("bigint").alias("edits"),
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; streams keep the one they were begun with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def settle(events: DataFrame, quiet_seconds: float = 1, gap_seconds: float | None = None,
           retry_seconds: float = 1) -> DataFrame:
    """A stream of events with every burst of edits replaced by its last one.

    An edit is released when its path has been quiet for ``quiet_seconds`` of processing time,
    with the time of its burst's first edit and the number of edits. With ``gap_seconds`` a
    burst also ends where the times of two edits lie further apart than that. Other events
    pass at once. Rows with ``attempts`` are failed changes; they are given out again after
    ``retry_seconds``, doubled with each attempt, unless a newer event comes first. A zero
    ``quiet_seconds`` holds no edit.
    """
    use_rocksdb(events.sparkSession)
    gap = None if gap_seconds is None else int(gap_seconds * 1_000_000)
    waiting = WaitingRows(int(quiet_seconds * 1000), gap, int(retry_seconds * 1000))
    out = _rows(events).filter("path IS NOT NULL").groupBy("path").transformWithState(
        statefulProcessor=waiting, outputStructType=ROW, outputMode="Append", timeMode="ProcessingTime"
    )

    def null(name: str, kind: str) -> Column:
        return F.nullif(F.col(name), F.lit(NONE)).cast(kind).alias(name)

    return out.select(
        F.timestamp_micros("ts").alias("ts"), null("seq", "bigint"), "kind", "path", "old_path",
        null("mtime", "bigint"), null("attempts", "int"), F.timestamp_micros("first_ts").alias("first_ts"), "edits",
    )


def bursts(settled: DataFrame) -> DataFrame:
    """The edits among settled events, in the shape that ``debounce`` gives."""
    return settled.filter("kind = 'modify'").select(
        "path", "first_ts", F.col("ts").alias("last_ts"), "seq", "mtime", "edits"
    )


_REASONS = {"new": "create", "modified": "modify", "deleted": "delete", "renamed": "rename"}


def as_events(failed: DataFrame, at=None) -> DataFrame:
    """Failed changes as rows for :func:`settle`, to be given out again."""
    kind = F.create_map(*[F.lit(x) for pair in _REASONS.items() for x in pair])
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return failed.select(
        when.alias("ts"), F.lit(0).cast("bigint").alias("seq"), kind[F.col("reason")].alias("kind"), "path",
        "old_path", "mtime", "attempts",
    )


def tried_again(settled: DataFrame) -> DataFrame:
    """The changes among settled events that had failed, as they were."""
    reason = F.create_map(*[F.lit(x) for r, k in _REASONS.items() for x in (k, r)])
    return settled.filter("attempts IS NOT NULL").select(
        "path", reason[F.col("kind")].alias("reason"), "mtime", "old_path", "attempts"
    ).select(*columns(CHANGES))
