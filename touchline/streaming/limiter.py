"""Rate decisions with keyed state (Q2s): one state a subject, with timers.

State of a subject: its newest day, and the counts of its day and minute
windows, kept for :data:`KEEP_DAYS` days before that day. A micro-batch's
requests of a subject count in (ts, id) order, after those decided before;
blocked requests count. Every request gets a decision: one without a time, one
for a window that is no longer kept (late), and one dated beyond the clock
by more than :data:`AHEAD` (future) are refused with that reason and change no
count, so neither can wipe or poison a subject's windows.

A timer clears a subject that has been idle for :data:`IDLE` of clock time. The
rows of a subject in a micro-batch are held by one task, so a deployment bounds
a micro-batch by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP_DAYS = 2
DAY, MINUTE = 86_400_000_000, 60_000_000  # microseconds
AHEAD = DAY
IDLE = 7 * 86_400_000  # milliseconds
STATE = "newest long, days array<long>, day_counts array<long>, minutes array<long>, minute_counts array<long>"
OUTPUT = "request_id long, subject_kind string, subject string, minute_count long, day_count long, allowed boolean, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(windows: np.ndarray, before: dict[int, int]) -> np.ndarray:
    """Place of each request in its window (sorted by time), after those before."""
    starts = np.flatnonzero(np.diff(windows, prepend=windows[0] - 1)) if windows.size else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, windows.size))
    earlier = np.array([before.get(int(w), 0) for w in windows[starts]], np.int64)
    return np.arange(windows.size) - np.repeat(starts, sizes) + 1 + np.repeat(earlier, sizes)


class Limiter(StatefulProcessor):
    def __init__(self, keep_days: int = KEEP_DAYS, ahead: int = AHEAD, idle: int = IDLE):
        self.keep_days, self.ahead, self.idle = keep_days, ahead, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs()
        newest, days, minutes = None, {}, {}
        if self.state.exists():
            newest, d, dn, m, mn = self.state.get()
            days, minutes = dict(zip(d, dn)), dict(zip(m, mn))
        ts = batch["ts_us"].to_numpy(np.float64, na_value=np.nan)
        timed = ~np.isnan(ts)
        ts = np.where(timed, ts, 0).astype(np.int64)
        future = timed & (ts > now * 1000 + self.ahead)
        late = timed & ~future & (ts // DAY < newest - self.keep_days if newest is not None else False)
        good = np.flatnonzero(timed & ~future & ~late)
        good = good[np.lexsort((batch["request_id"].to_numpy(np.int64)[good], ts[good]))]
        day, minute = ts[good] // DAY, ts[good] // MINUTE
        in_day, in_minute = counted(day, days), counted(minute, minutes)
        out = pd.DataFrame({"request_id": batch["request_id"].astype("int64"), "subject_kind": key[0], "subject": key[1],
                            "minute_count": pd.array([None] * len(batch), "Int64"), "day_count": pd.array([None] * len(batch), "Int64"),
                            "allowed": False, "reason": None})
        out["reason"] = np.select([~timed, future, late], ["no time", "future", "late"], None)
        over_minute = in_minute > batch["minute_limit"].to_numpy()[good]
        over_day = in_day > batch["day_limit"].to_numpy()[good]
        out.loc[good, "minute_count"], out.loc[good, "day_count"] = in_minute, in_day
        out.loc[good, "allowed"] = ~(over_minute | over_day)
        out.loc[good, "reason"] = np.select([over_minute, over_day], ["minute", "day"], None)
        if good.size:
            days |= {int(w): int(n) for w, n in zip(day, in_day)}  # the last of a window has its count
            minutes |= {int(w): int(n) for w, n in zip(minute, in_minute)}
            newest = max([int(day.max()), *([newest] if newest is not None else [])])
            first = newest - self.keep_days
            days = {w: n for w, n in days.items() if w >= first}
            minutes = {w: n for w, n in minutes.items() if w >= first * (DAY // MINUTE)}
            self.state.update((newest, list(days), list(days.values()), list(minutes), list(minutes.values())))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.idle)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, limits: DataFrame, **options) -> DataFrame:
    """A stream of decisions for a stream of ``request_id, subject_kind, subject, ts``;
    ``limits`` is a table of ``subject_kind, subject, minute_limit, day_limit``."""
    from pyspark.sql import functions as F

    rows = requests.join(limits.select("subject_kind", "subject", "minute_limit", "day_limit"), ["subject_kind", "subject"]).select(
        "request_id", "subject_kind", "subject", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "minute_limit", "day_limit")
    return rows.groupBy("subject_kind", "subject").transformWithStateInPandas(
        statefulProcessor=Limiter(**options), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
