"""Each issue's states, followed in the order of event time however its events arrive.

Events wait in the issue's state until the watermark has passed them and are then taken in order; what is
told at any time is the state so far with the waiting events, in order, on top.  So out-of-order events give
what a batch over all of them gives, as long as none comes later than the watermark allows.  An issue that
has been done for a time is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DONE_STATUSES = ("purchase",)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB, which state with several variables needs; the session's own choice comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def step(state: tuple, status: str, at: int, done: tuple[str, ...]) -> tuple:
    """(status, first done, last done, reopens, n) after one more event; times in microseconds, -1 for none."""
    last, first_done, last_done, reopens, n = state
    if status in done:
        first_done, last_done = (at if first_done < 0 else first_done), at
    elif last in done:
        reopens += 1
    return status, first_done, last_done, reopens, n + 1


START = ("", -1, -1, 0, 0)
OUT = "issue_id long, status string, first_done timestamp, last_done timestamp, reopens long, n long, settled long"


class Follow(StatefulProcessor):
    """Rows (issue_id, n, to_status, at in microseconds); ``forget_ms`` after its last event a done issue's state goes."""

    def __init__(self, done: tuple[str, ...], forget_ms: int):
        self.done, self.forget_ms = done, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value: each look at a state is a message to the JVM, so an issue's state is asked for and written once.
        self.held = handle.getValueState("held", "status string, first_done long, last_done long, reopens long, n long, at long, ats array<long>, ns array<long>, statuses array<string>")

    def _known(self) -> tuple[tuple, int, list]:
        """The state that is settled, when its last event was, and the events that wait."""
        x = self.held.get()
        return (tuple(x[:5]), x[5], list(zip(*x[6:9], strict=True))) if x else (START, -1, [])

    def _keep(self, state: tuple, last: int, waiting: list) -> None:
        self.held.update((*state, last, *([x[i] for x in waiting] for i in range(3))))

    def _told(self, key: tuple, state: tuple, rows: list, settled: int) -> Row:
        import datetime as dt

        for at, _, status in sorted(rows):
            state = step(state, status, at, self.done)
        instant = lambda us: None if us < 0 else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)
        return Row(issue_id=key[0], status=state[0], first_done=instant(state[1]), last_done=instant(state[2]), reopens=state[3], n=state[4], settled=settled)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(at, n, status) for _, n, status, at in rows]
        state, last, waiting = self._known()
        self._keep(state, last, waiting + new)
        self.handle.registerTimer(min(x[0] for x in new) // 1000)
        yield self._told(key, state, waiting + new, state[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        state, last, waiting = self._known()
        waiting.sort()
        due, left = [x for x in waiting if x[0] // 1000 <= passed], [x for x in waiting if x[0] // 1000 > passed]
        for at, _, status in due:
            state, last = step(state, status, at, self.done), at
        if not left and state[0] in self.done and last // 1000 + self.forget_ms <= passed:
            self.held.clear()
            return
        if due:
            self._keep(state, last, left)
        if left:
            self.handle.registerTimer(left[0][0] // 1000)
        elif state[0] in self.done:
            self.handle.registerTimer(last // 1000 + self.forget_ms)
        if due:
            yield self._told(key, state, left, state[4])

    def close(self) -> None:
        pass


def followed(events: DataFrame, late: str, done: tuple[str, ...] = DONE_STATUSES, forget_days: int = 90) -> DataFrame:
    """What is known of each issue whenever something is, of a stream (issue_id, n, to_status, moved_at).

    ``n`` counts the events seen and ``settled`` those that the watermark has passed: the last word of an
    issue is its row of the most of both.
    """
    rows = events.withWatermark("moved_at", late).withColumn("at", F.unix_micros("moved_at"))
    # An instant is dear to hand to Python row by row; its microseconds say the same, and the watermark stands already.
    keyed = rows.select("issue_id", "n", "to_status", "at").groupBy("issue_id")
    return keyed.transformWithState(Follow(tuple(done), forget_days * 86_400_000), OUT, "Update", "EventTime")
