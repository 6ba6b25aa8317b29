"""Batches of pages: disjoint ranges that tile a document, claimed, halved on failure and recovered.

The state of a (project, lang) is a set of ranges, keyed by first page.  A claim takes
the first pending one; a failed one is halved, down to ten pages, below which it has
failed for good; one that has run for three minutes without an end is pending again,
or halved if that was its second try.  Whatever happens, the ranges tile 1 to n.
``fold_batches`` derives the state from a log; ``batch_states`` is the same as a stream,
with ranges as map state and a timer for each that runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIZE, LEAST, TTL_MS, TRIES = 50, 10, 180_000, 2
#: ``first`` is the range's first page, and with a plan the document's number of pages.
EVENTS = "project_id long, lang string, event_id long, ts_ms long, kind string, first long"
STATE = "project_id long, lang string, first long, last long, status string, attempts int, version long"
NAMES = [f.split()[0] for f in EVENTS.split(", ")]
COLUMNS = [f.split()[0] for f in STATE.split(", ")]


@dataclass
class Range:
    last: int
    status: str = "pending"
    attempts: int = 0
    beat: int = 0


class Ranges(dict):
    """A document's ranges in memory."""

    def put(self, first: int, own: Range) -> None:
        self[first] = own

    def firsts(self) -> list[int]:
        return sorted(self)


@dataclass
class Batches:
    """``ranges`` is a ``Ranges`` or anything with get, put and firsts."""

    ranges: Any
    last: int = 0

    def step(self, kind: str, ts: int, first: int | None) -> None:
        self.last = max(self.last, ts)
        self.recover(ts)
        own = self.ranges.get(first) if first is not None else None
        if kind == "plan":
            if not self.ranges.firsts():
                for a in range(1, (first or 0) + 1, SIZE):
                    self.ranges.put(a, Range(min(a + SIZE - 1, first)))
        elif kind == "claim":
            open_ = next((a for a in self.ranges.firsts() if self.ranges.get(a).status == "pending"), None)
            if open_ is not None:
                r = self.ranges.get(open_)
                r.status, r.attempts, r.beat = "running", r.attempts + 1, ts
        elif own is None or own.status != "running":
            pass  # a late reply to a range that has been halved or recovered
        elif kind == "heartbeat":
            own.beat = ts
        elif kind == "done":
            own.status = "done"
        elif kind == "fail":
            self.halve(first, own)

    def halve(self, first: int, own: Range) -> None:
        size, last = own.last - first + 1, own.last
        if size <= LEAST:
            own.status = "failed"
            return
        new = max(LEAST, size // 2)
        for a in range(first, last + 1, new):
            self.ranges.put(a, Range(min(a + new - 1, last)))

    def recover(self, ts: int) -> None:
        for first in self.ranges.firsts():
            own = self.ranges.get(first)
            if own.status == "running" and ts - own.beat >= TTL_MS:
                if own.attempts >= TRIES and own.last - first + 1 > LEAST:
                    self.halve(first, own)
                else:
                    own.status = "pending"


def fold_batches(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """Ranges (``STATE``) of every document from the log (``EVENTS``), judged at ``as_of`` or at its last event.

    A log is read as a sorted stream; the state is as large as a document's number of ranges.
    """
    key = ["project_id", "lang"]
    ordered = events.select(*NAMES).repartition(*key).sortWithinPartitions(*key, "ts_ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, b = None, Batches(Ranges())

        def rows() -> pd.DataFrame:
            b.recover(b.last if as_of is None else as_of)
            return pd.DataFrame([(*now, a, b.ranges[a].last, b.ranges[a].status, b.ranges[a].attempts, None) for a in b.ranges.firsts()], columns=COLUMNS).astype({"version": "Int64"})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.project_id, r.lang) != now:
                    if now is not None:
                        yield rows()
                    now, b = (r.project_id, r.lang), Batches(Ranges())
                b.step(r.kind, int(r.ts_ms), None if pd.isna(r.first) else int(r.first))
        if now is not None:
            yield rows()

    return ordered.mapInPandas(run, STATE)


class StoredRanges:
    """Ranges in a map state; their first pages are a value state, as a claim needs them in order."""

    def __init__(self, state, firsts) -> None:
        self.state, self.value, self.seen, self.read = state, firsts, {}, {}
        self.own = list(firsts.get()[0]) if firsts.exists() else []

    def firsts(self) -> list[int]:
        return self.own

    def get(self, first: int) -> Range | None:
        if first not in self.seen:
            if not self.state.containsKey((first,)):
                return None
            *own, version = self.state.getValue((first,))
            self.seen[first], self.read[first] = Range(*own), (tuple(own), version)
        return self.seen[first]

    def put(self, first: int, own: Range) -> None:
        self.get(first)
        self.seen[first] = own
        self.own = sorted({*self.own, first})

    def written(self) -> list[tuple[int, Range, int]]:
        out = []
        for first, own in self.seen.items():
            before, version = self.read.get(first, (None, 0))
            if astuple(own) != before:
                self.state.updateValue((first,), (*astuple(own), version + 1))
                out.append((first, own, version + 1))
        self.value.update((self.own,))
        return sorted(out, key=lambda x: x[0])


class BatchProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranges = handle.getMapState("ranges", "first long", "last long, status string, attempts int, beat long, version long")
        self.firsts = handle.getValueState("firsts", "own array<long>")

    def _store(self, key: tuple, b: Batches) -> pd.DataFrame:
        changed = b.ranges.written()
        for at in {own.beat + TTL_MS for _, own, _ in changed if own.status == "running"}:
            self.handle.registerTimer(at)
        return pd.DataFrame([(*key, a, own.last, own.status, own.attempts, version) for a, own, version in changed], columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = Batches(StoredRanges(self.ranges, self.firsts))
        for r in pd.concat(list(rows)).sort_values(["ts_ms", "event_id"]).itertuples(index=False):
            b.step(r.kind, int(r.ts_ms), None if pd.isna(r.first) else int(r.first))
        yield self._store(key, b)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = Batches(StoredRanges(self.ranges, self.firsts))
        b.recover(expiredTimerInfo.getExpiryTimeInMs())
        yield self._store(key, b)

    def close(self) -> None:
        pass


def batch_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream of ranges that have changed (``STATE``); a range that runs is recovered when the watermark passes its time."""
    own = events.select(*NAMES).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return own.groupBy("project_id", "lang").transformWithStateInPandas(BatchProcessor(), STATE, "update", "eventTime")
