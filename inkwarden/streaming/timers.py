"""Inspections of changing paths as keyed state with timers.

Changes of a path (path, at, seq, cancel, sha256, error) are gathered until ``debounce``
after the first of them, whatever still arrives, and then decided on once, by the last
content: SCAN, SKIP for content that has been inspected in this context, or FAILED, with
the error that reading gave. What failed is tried again (RETRY) ``retry`` after that, unless
the path has changed or the error is one that stays. A row with ``cancel`` starts a new
generation of its path: what was waiting is CANCELLED or, if it was a retry, dropped.

The state of a path is one row; its timer is the next of its due times in event time, so
that a decision falls when the watermark has passed it, whether or not the path has
another row. Between the rows of one batch decisions are made in the order of time, so
batches make no difference, and neither do restarts.

Cases: rows with null paths are one path; null contents with no error count as contents of
their own; rows of one time go by ``seq``; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .incremental import PERMANENT

#: Fixed values, in milliseconds: from the first change to the inspection, and from a failure to the next attempt.
DEBOUNCE_MS, RETRY_MS = 750, 3000
ACTIONS = "path string, action string, at timestamp, sha256 string, error string, generation long, changes long"
#: generation; the waiting change: due, sha256, error, number of changes; what was inspected last; when and what to retry, and how often it has failed.
STATE = "generation long, due long, sha256 string, error string, changes long, known boolean, ok_sha256 string, ok_context string, retry long, retry_sha256 string, retry_error string"
_STATE = [x.split()[0] for x in STATE.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _none(x: object) -> object:
    """null as None, which pandas may have turned into something else."""
    return None if x is None or x is pd.NaT or x != x else x


class Schedule:
    """One path: its state, and the actions that follow from it."""

    def __init__(self, path: str | None, state: dict | None, context: str, debounce: int, retry: int):
        self.path, self.context, self.debounce, self.retry_after = path, context, debounce, retry
        self.s = state or dict.fromkeys(_STATE) | {"generation": 0, "known": False}
        self.out: list[tuple] = []

    def _say(self, action: str, at: int, sha: str | None, error: str | None, changes: int) -> None:
        self.out.append((self.path, action, pd.Timestamp(at, unit="ms"), sha, error, self.s["generation"], changes))

    def next(self) -> int | None:
        return min((t for t in (self.s["due"], self.s["retry"]) if t is not None), default=None)

    def settle(self, now: int) -> None:
        """What is due up to ``now``, in the order of time."""
        while (at := self.next()) is not None and at <= now:
            if self.s["due"] == at:
                self._decide(at)
            else:
                self._say("RETRY", at, self.s["retry_sha256"], self.s["retry_error"], 0)
                self.s |= {"retry": None}

    def _decide(self, at: int) -> None:
        sha, error, changes = self.s["sha256"], self.s["error"], self.s["changes"]
        self.s |= {"due": None}
        if error is not None:
            self._say("FAILED", at, sha, error, changes)
            self.s |= {"known": False}
            if error not in PERMANENT:
                self.s |= {"retry": at + self.retry_after, "retry_sha256": sha, "retry_error": error}
            return
        same = self.s["known"] and (self.s["ok_sha256"], self.s["ok_context"]) == (sha, self.context)
        self._say("SKIP" if same else "SCAN", at, sha, None, changes)
        self.s |= {"known": True, "ok_sha256": sha, "ok_context": self.context}

    def change(self, at: int, sha: str | None, error: str | None) -> None:
        self.settle(at)
        first = self.s["due"] is None
        self.s |= {"due": at + self.debounce if first else self.s["due"], "changes": 1 if first else self.s["changes"] + 1, "sha256": sha, "error": error, "retry": None}

    def cancel(self, at: int) -> None:
        self.settle(at)
        if self.s["due"] is not None:
            self._say("CANCELLED", at, self.s["sha256"], self.s["error"], self.s["changes"])
        self.s |= {"due": None, "retry": None, "generation": self.s["generation"] + 1}


class Inspections(StatefulProcessor):
    def __init__(self, context: str, debounce: int, retry: int):
        self.context, self.debounce, self.retry_after = context, debounce, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("path", STATE)

    def _of(self, key: tuple) -> Schedule:
        state = dict(zip(_STATE, map(_none, self.state.get()), strict=True)) if self.state.exists() else None
        return Schedule(_none(key[0]), state, self.context, self.debounce, self.retry_after)

    def _kept(self, schedule: Schedule) -> Iterator[pd.DataFrame]:
        self.state.update(tuple(schedule.s[c] for c in _STATE))
        if (at := schedule.next()) is not None:
            self.handle.registerTimer(at)
        if schedule.out:
            yield pd.DataFrame(schedule.out, columns=[x.split()[0] for x in ACTIONS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        schedule = self._of(key)
        every = pd.concat(rows).sort_values(["ms", "seq"], kind="stable")
        for ms, cancel, sha, error in every[["ms", "cancel", "sha256", "error"]].itertuples(index=False, name=None):
            schedule.cancel(int(ms)) if cancel else schedule.change(int(ms), _none(sha), _none(error))
        yield from self._kept(schedule)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        schedule = self._of(key)
        # All that is before the watermark: a timer that is set here for then would wait for another batch.
        schedule.settle(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1))
        yield from self._kept(schedule)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in a store that has timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def inspections(changes: DataFrame, context: str, debounce: int = DEBOUNCE_MS, retry: int = RETRY_MS, late: str = "0 seconds") -> DataFrame:
    """The actions that follow from a stream of changes; start its query within :func:`timed_state`.

    ``late`` is how far rows of different paths may be out of order.
    """
    rows = changes.select("path", F.col("at").cast("timestamp").alias("at"), "seq", "cancel", "sha256", "error").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("path").transformWithStateInPandas(Inspections(context, debounce, retry), ACTIONS, "Append", "EventTime")


def run(changes: DataFrame, out: str, checkpoint: str, context: str, **kw) -> None:
    """Write the actions of what has arrived as Parquet and stop; the checkpoint is where the next run goes on."""
    with timed_state(changes.sparkSession):
        actions = inspections(changes, context, **kw)
        actions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
