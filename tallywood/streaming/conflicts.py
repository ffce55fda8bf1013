"""Conflicts of a stream of facts: open episodes kept as state, closed by timers, the same rows as the batch detector's.

The state of a subject and concept holds the days and distinct values of its open episodes (first fact, number,
documents), not the facts. An episode is closed when the watermark has passed its last day by the window: no fact that is
still admitted can belong to it. Then its values are folded into groups in the order of their first facts,
whatever the order in which they came, and its conflicts are emitted. Facts later than the watermark are dropped
by Spark and show up in the query's progress.

Every call of a state store is a message between processes, so a key's facts of a batch are summed up first and appended in
chunks, unread; what was appended is put together when a timer fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.conflicts import UNRESOLVED
from ..operators.episodes import _Fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
OUTPUT = "subject string, concept string, episode long, left_id long, right_id long, left_value double, right_value double, delta double, n_left int, n_right int, episode_start date, episode_end date, status string"
_ROW = Row(*[x.split(" ")[0] for x in OUTPUT.split(", ")])
#: Days and values in one entry of the state.
CHUNK = 10_000
_NAN = float("nan")  # one object, so that NaN is equal to itself as a key


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _add(places: dict, day: int, value: float, first: int, n: int, low: int | None, high: int | None, without: int) -> None:
    place = (day, value + 0.0 if value == value else _NAN)
    old = places.get(place)
    places[place] = (first, n, low, high, without) if old is None else (min(old[0], first), old[1] + n, _least(old[2], low), _most(old[3], high), old[4] + without)


class EpisodeConflicts(StatefulProcessor):
    """rules: concept to (absolute limit, relative limit, window in days)."""

    def __init__(self, rules: dict[str, tuple[float | None, float | None, int]], default_window: int = 2):
        self.rules, self.default_window = rules, default_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Chunks of days and values, and how many episodes had been closed when a chunk was written.
        self.open = handle.getListState("open", "day array<int>, value array<double>, first_id array<long>, n array<int>, low_document array<long>, high_document array<long>, without array<int>, closed long")

    def _rule(self, concept):
        return self.rules.get(concept, (None, None, self.default_window))

    @staticmethod
    def _chunks(places: list[tuple], closed: int) -> list[tuple]:
        parts = [places[k : k + CHUNK] for k in range(0, len(places), CHUNK)] or [[]]
        return [(*([place[i] for place, _ in part] for i in range(2)), *([state[i] for _, state in part] for i in range(5)), closed) for part in parts]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        places: dict[tuple, tuple] = {}
        earliest = None
        for row in rows:
            _add(places, row.day, row.value, row.fact_id, 1, row.document_id, row.document_id, int(row.document_id is None))
            earliest = _least(earliest, row.day)
            if len(places) == CHUNK:
                self.open.appendList(self._chunks(list(places.items()), 0))
                places = {}
        if places:
            self.open.appendList(self._chunks(list(places.items()), 0))
        if earliest is not None:  # the first day on which an episode of these facts may close
            self.handle.registerTimer((earliest + self._rule(key[1])[2] + 1) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, window = timerValues.getCurrentWatermarkInMs(), self._rule(key[1])[2]
        held: dict[tuple, tuple] = {}
        number = 0
        for *columns, closed in self.open.get():
            number = max(number, closed)
            for x in zip(*columns):
                _add(held, *x)
        spans: list[list[tuple]] = []  # (place, state) of each open episode, by day
        for place, state in sorted(held.items(), key=lambda x: (x[0][0], x[1][0])):
            if not spans or place[0] - spans[-1][-1][0][0] > window:
                spans.append([])
            spans[-1].append((place, state))
        shut = lambda span: (span[-1][0][0] + window + 1) * DAY_MS
        left = 0
        while left < len(spans) and shut(spans[left]) <= passed:
            number += 1
            yield from self._conflicts(key, number, spans[left])
            left += 1
        self.open.put(self._chunks([x for span in spans[left:] for x in span], number))
        if left < len(spans):
            self.handle.registerTimer(shut(spans[left]))

    def _conflicts(self, key, number: int, span: list[tuple]) -> Iterator[Row]:
        values: dict[float, list] = {}  # of the episode, in the order of their first facts
        for (day, value), (first, n, low, high, without) in span:
            own = values.setdefault(value, [day, first, day, 0, None, None, 0])
            own[2:] = [day, own[3] + n, _least(own[4], low), _most(own[5], high), own[6] + without]
        if len(values) < 2:
            return
        limit, share, _ = self._rule(key[1])
        group, _ = _Fold(limit, share).take(np.array(list(values), float))
        groups: dict[int, list] = {}
        for g, (value, own) in zip(group.tolist(), values.items()):
            held = groups.setdefault(g, [value, *own])
            if held[1:] != own:
                held[3] = max(held[3], own[2])
                held[4] += own[3]
                held[5:7] = [_least(held[5], own[4]), _most(held[6], own[5])]
                held[7] += own[6]
        day = lambda d: np.datetime64(d, "D").astype(object)
        order = [groups[g] for g in sorted(groups)]
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                lows, highs = [x for x in (a[5], b[5]) if x is not None], [x for x in (a[6], b[6]) if x is not None]
                if lows and (min(lows) < max(highs) or a[7] + b[7] > 0):
                    yield _ROW(*key, number, a[2], b[2], a[0], b[0], round(b[0] - a[0], 6), a[4], b[4], day(min(a[1], b[1])), day(max(a[3], b[3])), UNRESOLVED)

    def close(self) -> None:
        pass


def streaming_conflicts(facts: DataFrame, rules: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Numeric conflicts of a stream of facts: subject, concept, fact_id, obs_time (a day's timestamp), value, document_id.

    rules: concept, abs_limit, rel_limit, window_days, a literal table. A null subject is a group of its own; facts without a
    value or time are no part of an episode. An episode's conflicts come once, when it is closed.
    """
    spark = facts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    table = {r.concept: (r.abs_limit, r.rel_limit, r.window_days) for r in rules.collect()}  # a row for each concept
    rows = facts.where("value is not null and obs_time is not null").select(F.col("subject").cast("string"), "concept", F.col("fact_id").cast("long"), "obs_time", F.unix_date(F.to_date("obs_time")).alias("day"), F.col("value").cast("double"), F.col("document_id").cast("long"))
    return rows.withWatermark("obs_time", lateness).groupBy("subject", "concept").transformWithState(EpisodeConflicts(table), OUTPUT, "append", "eventtime")
