"""Spikes of weekly volume over a stream: the state of an entity is its last weeks' counts, and a week is judged once all that it is judged by is over.

A week's median reaches half a window to both sides, and its spread the medians of these; so a week is decided when the window before and the
window after it are closed by the watermark. What is emitted equals volume.robust_spikes of all weeks at once, for the weeks that are decided.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs; set it on a session before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "entity string, start date, postings long, local_median double, robust_z double, poisson_z double, is_spike boolean, is_trough boolean"
_WEEK_MS, _MONDAY = 7 * 86_400_000, 4 * 86_400_000  # the first Monday after the epoch


def week_of(ms: int) -> int:
    """Number of the week (from Monday) that an instant (UTC) is in."""
    return (ms - _MONDAY) // _WEEK_MS


def end_of(week: int) -> int:
    return (week + 1) * _WEEK_MS + _MONDAY


def _middle(values: np.ndarray) -> float:
    return float(np.median(values)) if len(values) >= 3 else np.nan


def judged(counts: np.ndarray, at: int, side: int, threshold: float, poisson: float) -> tuple[float | None, float | None, float | None, bool, bool]:
    """local_median, robust_z, poisson_z, is_spike, is_trough of the week at a place of a row of weekly counts."""
    v = counts.astype(float)
    around = range(max(0, at - side), min(len(v), at + side + 1))
    medians = {k: _middle(v[max(0, k - side) : k + side + 1]) for k in around}
    spread = _middle(np.array([abs(v[k] - m) for k, m in medians.items() if not np.isnan(m)]))
    median = medians[at]
    if np.isnan(median):
        return None, None, None, False, False
    off = v[at] - median
    z = None if np.isnan(spread) or spread == 0 else 0.6745 * off / spread
    p = off / max(median, 1.0) ** 0.5
    beyond = lambda s: s * p >= poisson if z is None else s * z >= threshold
    return median, z, p, bool(beyond(1)), bool(beyond(-1))


class Spikes(StatefulProcessor):
    """Holds an entity's weekly counts from a window before the next undecided week on."""

    def __init__(self, window: int, threshold: float, poisson: float):
        self.window, self.threshold, self.poisson = window, threshold, poisson

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("weeks", "first long, next long, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        weeks = [week_of(int(t)) for pdf in rows for t in pdf["ts"].astype("datetime64[ms]").astype("int64")]
        held = self.state.get() if self.state.exists() else None
        if held is None:
            first = upcoming = min(weeks)
            counts = []
        else:
            first, upcoming, counts = held[0], held[1], list(held[2])
            if min(weeks) < first and first == upcoming:  # a week before the first one known, while none is decided
                counts, first = [0] * (first - min(weeks)) + counts, min(weeks)
                upcoming = first
        for w in weeks:
            if w >= first:
                counts += [0] * (w - first + 1 - len(counts))
                counts[w - first] += 1
        yield self._decide(key, first, upcoming, counts, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, upcoming, counts = self.state.get()
        yield self._decide(key, first, upcoming, list(counts), timerValues)

    def _decide(self, key, first: int, upcoming: int, counts: list[int], timerValues) -> pd.DataFrame:
        """Rows of the weeks that are decided by now; the state after them."""
        side, out = self.window // 2, []
        last = week_of(timerValues.getCurrentWatermarkInMs()) - 1  # the last week that is closed
        known = first + len(counts) - 1
        while upcoming + 2 * side <= min(last, known):
            v = np.array(counts[: upcoming + 2 * side - first + 1])
            day = datetime.date(1970, 1, 5) + datetime.timedelta(weeks=upcoming)
            out.append((key[0], day, int(v[upcoming - first]), *judged(v, upcoming - first, side, self.threshold, self.poisson)))
            upcoming += 1
            if upcoming - first > 2 * side:
                counts, first = counts[1:], first + 1
        self.state.update((first, upcoming, counts))
        self.handle.registerTimer(end_of(upcoming + 2 * side))
        return pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def spikes(stream: DataFrame, delay: str = "7 days", window: int = 9, threshold: float = 3.5, poisson: float = 3.0) -> DataFrame:
    """Judged weeks of every entity of a stream (id, entity, ts): entity, start, postings, local_median, robust_z, poisson_z, is_spike, is_trough.

    Rows later than delay are dropped by the watermark, ids that come again within it count once. A session needs STATE_STORE. State an entity: some two
    windows of counts, whatever its volume. Weeks without a posting between an entity's first and last one count as zero."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("entity").transformWithStateInPandas(Spikes(window, threshold, poisson), OUTPUT, outputMode="Append", timeMode="EventTime")
