"""Repeated findings with state of their own: what repeats within a time is one episode, and only episodes that change are written."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds since the epoch in here.
EPISODE = "event_type string, package string, first_us long, last_us long, occurrences long"


class Episodes(StatefulProcessor):
    """For each key its open episode: first and last time and number.  A pause longer than ``pause`` opens another.

    A timer clears the state when the watermark has passed the last time by ``pause``, as no row can then join it.  A late
    row that lies before the open episode by more than the pause is an episode by itself.
    """

    def __init__(self, pause: timedelta) -> None:
        self.pause = pause // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us long, last_us long, occurrences long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = sorted(r.us for r in rows)
        first, last, n = self.open.get() if self.open.exists() else (None, None, 0)
        before = last
        changed: dict[int, tuple] = {}
        for us in times:
            if first is not None and us < first - self.pause:
                changed[us] = (us, us, 1)
                continue
            if first is None or us - last > self.pause:
                first, last, n = us, us, 0
            changed.pop(first, None)
            first, last, n = min(first, us), max(last, us), n + 1
            changed[first] = (first, last, n)
        self.open.update((first, last, n))
        if before is not None:
            self.handle.deleteTimer(self._expiry(before))
        self.handle.registerTimer(self._expiry(last))
        for episode in changed.values():
            yield Row(event_type=key[0], package=key[1], first_us=episode[0], last_us=episode[1], occurrences=episode[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter(())

    def _expiry(self, last: int) -> int:
        return (last + self.pause) // 1000 + 1

    def close(self) -> None:
        pass


def episodes(events: DataFrame, pause: timedelta = timedelta(days=2), late: str = "1 hour") -> DataFrame:
    """``event_type, package, first_ts, last_ts, occurrences`` of episodes, in update mode: each as often as it changes."""
    keyed = events.select("event_type", "package", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late).groupBy("event_type", "package")
    out = keyed.transformWithState(Episodes(pause), EPISODE, "Update", "EventTime")
    return out.select("event_type", "package", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "occurrences")
