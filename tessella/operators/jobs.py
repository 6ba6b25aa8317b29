"""The work queue: derived from an append-only log of events, never patched.

``fold_jobs`` is the state machine over one project's ordered events; the batch
job folds each project on its own and the streaming job (``streaming.queue``)
runs the same step function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import scan

RATE, WINDOW_MS, DAILY = 10, 60_000, 1_200
TTL_MS, MOST_ATTEMPTS, WORKERS = 180_000, 10, 2
PACIFIC = ZoneInfo("America/Los_Angeles")
#: Failed pairs of a chunk after which its language is not paired again, and tokens of a pair's request.
TRIPS, PAIR_TOKENS = 2, 6_000
#: ``n_chars`` is the size of an enqueued text, or of the text that resolves a review (null or 0: back to the queue).
EVENTS = "project_id long, event_id long, ts_ms long, kind string, lang string, chunk_index int, token string, retry_after_ms long, n_chars long"


def pacific_date(ts: Column) -> Column:
    """Calendar day in Pacific time of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "America/Los_Angeles"))


def ms_to_pacific_midnight(ts: Column) -> Column:
    local = F.from_utc_timestamp(ts.cast("timestamp"), "America/Los_Angeles")
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return F.greatest(F.lit(86_400_000) - seconds * 1000, F.lit(60_000)).cast("long")


def offered_load(events: DataFrame, window_s: int = 60) -> DataFrame:
    """Requests of the same project in the window up to each one, by time."""
    order = W.partitionBy("project_id").orderBy(F.col("ts_us")).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return events.withColumn("offered", F.count(F.lit(1)).over(order))


def admitted(requests: DataFrame, cap: int = RATE, window_ms: int = WINDOW_MS, daily: int | None = None) -> DataFrame:
    """(project_id, event_id, verdict): "ok", "rpm" or "daily", in order of (ts_ms, event_id).

    A refused request does not count, so acceptance feeds back and no window
    frame can express it: each project's times are folded in order.  The fold
    keeps a ring of at most ``cap`` times, however long the project's log is,
    and reads the log as a sorted stream, not as one array.
    """
    ordered = requests.select("project_id", "event_id", "ts_ms", pacific_date(F.timestamp_millis("ts_ms")).cast("string").alias("day")).repartition("project_id").sortWithinPartitions("project_id", "ts_ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, ring, day, today = None, [], None, 0
        for rows in batches:
            out = []
            for p, ts, d in zip(rows.project_id.tolist(), rows.ts_ms.tolist(), rows.day.tolist(), strict=True):
                if p != project:
                    project, ring, day, today = p, [], None, 0
                if d != day:
                    day, today = d, 0
                ring = [t for t in ring if ts - t < window_ms]
                if len(ring) >= cap:
                    out.append("rpm")
                elif daily is not None and today >= daily:
                    out.append("daily")
                else:
                    ring.append(ts)
                    today += 1
                    out.append("ok")
            yield rows[["project_id", "event_id"]].assign(verdict=out)

    return ordered.mapInPandas(run, "project_id long, event_id long, verdict string")


def streak_429(events: DataFrame, workers: int = WORKERS, width_ms: int = scan.TIMES) -> DataFrame:
    """Consecutive 429s up to each event of kind http429, reset by an ok (``streak``), and the worker limit after it (``workers``).

    One worker fewer from the third on, half as many from the fourth on, one at least; an ok gives none back.
    Both are parallel scans over buckets of ``width_ms``, as one project may have most of the log.
    """
    key, order = ["project_id"], ["ts_ms", "event_id"]
    bucket = scan.bucket_of(F.col("ts_ms"), width_ms)
    signals = scan.running(events.where(F.col("kind").isin("ok", "http429")), key, bucket, order, island=(F.col("kind") == "ok").cast("long"))
    refused = scan.numbered(signals.where("kind = 'http429'"), ["project_id", "island"], bucket, order, "streak")

    def fewer(limits: np.ndarray, streak: int) -> np.ndarray:
        if streak >= 3:
            limits = np.maximum(1, limits - 1)
        if streak >= 4:
            limits = np.maximum(1, limits // 2)
        return limits

    return scan.folded(refused.drop("island"), key, bucket, order, "streak", workers + 1, fewer, workers).drop("before").withColumnRenamed("after", "workers")


def accepted_stages(events: DataFrame) -> DataFrame:
    """(project_id, stage): a stage event counts only if it expects the current number, then adds one.

    ``events`` has project_id, ts_ms, event_id, expected.  A guarded counter
    needs no fold: number n is passed by the first event after n - 1's that
    expects n - 1, so a sorted stream and one number suffice.
    """
    ordered = events.select("project_id", "ts_ms", "event_id", "expected").repartition("project_id").sortWithinPartitions("project_id", "ts_ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, stage, seen = None, 0, False
        for rows in batches:
            out = []
            for p, e in zip(rows.project_id.tolist(), rows.expected.tolist(), strict=True):
                if seen and p != project:
                    out.append((project, stage))
                    stage = 0
                project, seen = p, True
                stage += e == stage
            yield pd.DataFrame(out, columns=["project_id", "stage"])
        if seen:
            yield pd.DataFrame([(project, stage)], columns=["project_id", "stage"])

    return ordered.mapInPandas(run, "project_id long, stage int")


@dataclass
class Job:
    status: str = "pending"
    token: str | None = None
    beat: int = 0
    attempts: int = 0
    reclaimed: int = 0
    due: int = 0
    n_chars: int = 0
    pair_failures: int = 0
    #: Whether a reply has been asked for again with the strict prompt.
    retried: bool = False

    def lapse(self, ts: int) -> None:
        """A lease without a heartbeat for three minutes ends; a retry that is due is pending again."""
        if self.status == "claimed" and ts - self.beat >= TTL_MS:
            self.status, self.token, self.reclaimed = "pending", None, self.reclaimed + 1
        elif self.status == "retry_wait" and self.due <= ts:
            self.status = "pending"

    def deadline(self) -> int | None:
        """When the job lapses if nothing happens before."""
        return self.beat + TTL_MS if self.status == "claimed" else self.due if self.status == "retry_wait" else None


def pair_tokens(a: int, b: int, separator: int = 60, overhead: int = 800) -> int:
    """Tokens of two texts in one request, as ``chunking.safe_pair_tokens`` counts them."""
    return -(-(-(-(a + separator + b + overhead) // 4)) * 12 // 10)


@dataclass
class Queue:
    """One project's state: its jobs (by language and index), ring of accepted requests, day counter, 429 streak, worker limit and languages that are not paired.

    ``jobs`` is a dict or anything with get, put and items; a job lapses when it is looked at, so no event
    looks at jobs that it does not name, but for a cancellation.
    """

    jobs: Any = field(default_factory=lambda: Jobs())
    ring: list = field(default_factory=list)
    day: str = ""
    today: int = 0
    streak: int = 0
    workers: int = WORKERS
    stale: int = 0
    refused: int = 0
    tripped: list = field(default_factory=list)
    last: int = 0

    def step(self, kind: str, ts: int, key: tuple, token: str | None, retry_after: int | None, n_chars: int | None = None) -> None:
        self.last = max(self.last, ts)
        job = self.job(key, ts)
        if kind == "enqueue":
            if job is None:
                self.jobs.put(key, Job(n_chars=n_chars or 0))
        elif kind in ("claim", "claim_pair"):
            self.claim(ts, key, job, token, kind == "claim_pair")
        elif kind == "release":
            if self.ring:
                self.ring.pop()
                self.today = max(0, self.today - 1)
        elif kind == "cancel":
            for _, j in self.jobs.items():
                j.lapse(ts)
                if j.status not in ("done", "failed"):
                    j.status = "cancelled"
        elif kind == "resolve":
            # By hand: with a text the chunk is done, without one it starts afresh.
            if job and job.status == "needs_review":
                job.status, job.retried = ("done", job.retried) if n_chars else ("pending", False)
        elif job is None:
            pass
        elif job.status != "claimed" or job.token != token:
            self.stale += 1  # a worker that lost its lease, or a late reply to a chunk that has been resolved
        else:
            self.reply(kind, ts, key, job, token, retry_after)

    def job(self, key: tuple, ts: int) -> Job | None:
        job = self.jobs.get(key)
        if job:
            job.lapse(ts)
        return job

    def claim(self, ts: int, key: tuple, job: Job | None, token: str | None, pair: bool) -> None:
        """Lease a chunk, or with the next one if that is pending, its language may be paired, and both fit one request."""
        if not job or job.status != "pending":
            return
        if not self.admit(ts):
            self.refused += 1
            return
        other = self.job((key[0], key[1] + 1), ts) if pair and key[0] not in self.tripped else None
        if other and (other.status != "pending" or pair_tokens(job.n_chars, other.n_chars) > PAIR_TOKENS):
            other = None
        for j in (job, other):
            if j:
                j.status, j.token, j.beat = "claimed", token, ts

    def reply(self, kind: str, ts: int, key: tuple, job: Job, token: str | None, retry_after: int | None) -> None:
        if kind == "heartbeat":
            job.beat = ts
        elif kind == "ok":
            job.status, self.streak = "done", 0
        elif kind in ("fail", "http429"):
            job.attempts += 1
            if kind == "http429":
                self.streak += 1
                if self.streak >= 3:
                    self.workers = max(1, self.workers - 1)
                if self.streak >= 4:
                    self.workers = max(1, self.workers // 2)
            delay = max(min(120_000, 2_000 * 2 ** min(job.attempts - 1, 16)), int(retry_after or 0))
            job.status, job.due = ("failed", 0) if job.attempts >= MOST_ATTEMPTS else ("retry_wait", ts + delay)
        elif kind == "pair_split":
            # One unit of work is two again; the first one counts the failures.
            job.pair_failures += 1
            other = self.job((key[0], key[1] + 1), ts)
            for j in (job, other if other and other.status == "claimed" and other.token == token else None):
                if j:
                    j.status, j.token = "pending", None
            if job.pair_failures >= TRIPS and key[0] not in self.tripped:
                self.tripped = sorted([*self.tripped, key[0]])
        elif kind == "contract_retry":
            job.retried = True
        elif kind == "review":
            job.status, job.token = "needs_review", None

    def admit(self, ts: int) -> bool:
        day = datetime.fromtimestamp(ts / 1000, UTC).astimezone(PACIFIC).date().isoformat()
        if day != self.day:
            self.day, self.today = day, 0
        self.ring = [t for t in self.ring if ts - t < WINDOW_MS]
        if len(self.ring) >= RATE or self.today >= DAILY:
            return False
        self.ring.append(ts)
        self.today += 1
        return True


class Jobs(dict):
    """Jobs of a project in memory."""

    def put(self, key: tuple, job: Job) -> None:
        self[key] = job


#: Rows of jobs, and one row a project (of no language) with what all its jobs share; a stream counts a row's versions.
STATE = "project_id long, lang string, chunk_index int, status string, attempts int, reclaimed int, pair_failures int, retried boolean, workers int, stale int, refused int, tripped array<string>, version long"
COLUMNS = [f.split()[0] for f in STATE.split(", ")]


def job_row(project: int, key: tuple, j: Job, version: int | None = None) -> tuple:
    return (project, *key, j.status, j.attempts, j.reclaimed, j.pair_failures, j.retried, None, None, None, None, version)


def project_row(project: int, q: Queue, version: int | None = None) -> tuple:
    return (project, None, None, None, None, None, None, None, q.workers, q.stale, q.refused, list(q.tripped), version)


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in ("chunk_index", "attempts", "reclaimed", "pair_failures", "workers", "stale", "refused", "version")} | {"retried": "boolean"})


def take(q: Queue, rows: pd.DataFrame) -> None:
    """Step through ordered events."""
    number = lambda x: None if pd.isna(x) else int(x)
    for r in rows.itertuples(index=False):
        q.step(r.kind, int(r.ts_ms), (r.lang, number(r.chunk_index)), r.token, number(r.retry_after_ms), number(r.n_chars))


def fold_jobs(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """Final state (``STATE``) of every job, and of every project, from the log of events (``EVENTS``).

    Leases and retries are judged at ``as_of``, or at the project's last event.  A project's log is read as a
    sorted stream; its state is as large as its number of jobs.
    """
    names = [f.split()[0] for f in EVENTS.split(", ")]
    ordered = events.select(*names).repartition("project_id").sortWithinPartitions("project_id", "ts_ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, q = None, Queue()

        def rows() -> pd.DataFrame:
            for j in q.jobs.values():
                j.lapse(q.last if as_of is None else as_of)
            return as_frame([*(job_row(project, key, j) for key, j in sorted(q.jobs.items())), project_row(project, q)])

        for batch in batches:
            for own, part in batch.groupby("project_id", sort=False):
                if project is not None and own != project:
                    yield rows()
                    q = Queue()
                project = own
                take(q, part)
        if project is not None:
            yield rows()

    return ordered.mapInPandas(run, STATE)


def enqueue(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs to create: wanted keys that are not there yet, each once."""
    key = ["project_id", "lang", "chunk_index"]
    return wanted.dropDuplicates(key).join(existing.select(key), key, "left_anti")


def heal(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs that are not done though their chunk's result is there."""
    key = ["project_id", "lang", "chunk_index"]
    return jobs.where("status <> 'done'").join(chunks.where("status = 'done'").select(key), key, "left_semi")


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimed jobs whose heartbeat is null or at least three minutes old."""
    return jobs.where((F.col("status") == "claimed") & (F.col("heartbeat_at").isNull() | (now - F.col("heartbeat_at") >= TTL_MS)))


def retry_due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "retry_wait") & (F.coalesce("next_retry_at", F.lit(0)) <= now))


def watchdog_counters(jobs: DataFrame, now: Column, batches: DataFrame | None = None, dispatchers: DataFrame | None = None) -> DataFrame:
    """What one sweep would do, in one row: leases reclaimed, retries promoted, jobs open, projects seen; page ranges recovered; dispatchers revived, in either mode, and projects that any of it touches.

    ``batches`` has project_id, status, heartbeat_at; ``dispatchers`` project_id, mode and lease_at (null: none).
    """
    beat = F.col("heartbeat_at")
    lost = F.col("heartbeat_at").isNull() | (now - beat >= TTL_MS)
    due = (F.col("status") == "retry_wait") & (F.coalesce("next_retry_at", F.lit(0)) <= now)
    reclaimed = (F.col("status") == "claimed") & lost
    out = jobs.agg(
        F.count_if(reclaimed).alias("reclaimed"), F.count_if(due).alias("promoted"), F.count_if(F.col("status").isin("pending", "claimed", "retry_wait", "needs_review")).alias("open"), F.count_distinct("project_id").alias("projects"),
    )
    touched = jobs.where(reclaimed | due).select("project_id")
    if batches is not None:
        stuck = batches.where((F.col("status") == "running") & lost)
        out, touched = out.join(stuck.agg(F.count(F.lit(1)).alias("batches"))), touched.union(stuck.select("project_id"))
    if dispatchers is not None:
        silent = dispatchers.where(F.col("lease_at").isNull() | (now - F.col("lease_at") >= 2 * TTL_MS)).join(jobs.where(F.col("status").isin("pending", "claimed", "retry_wait")).select("project_id").distinct(), "project_id", "left_semi")
        out = out.join(silent.agg(F.count_if(F.col("mode") == "adaptive").alias("revived"), F.count_if(F.col("mode") == "legacy").alias("legacy_revived")))
        touched = touched.union(silent.select("project_id"))
    return out if batches is None and dispatchers is None else out.join(touched.agg(F.count_distinct("project_id").alias("touched")))


def lease_action(status: Column, paused_until: Column, day: Column, today: Column, lease_at: Column, now: Column, ttl_ms: int = 2 * TTL_MS) -> Column:
    """What to do about a project's dispatcher lease, first match wins."""
    return (
        F.when(status.isin("cancelled", "complete"), "blocked").when(paused_until > now, F.when(day != today, "day_reset").otherwise("paused"))
        .when(lease_at.isNotNull() & (now - lease_at < ttl_ms), "fresh_lease").otherwise("take")
    )


def alive(*beats: Column, now: Column, ttl_ms: int = 12 * 60_000) -> Column:
    return F.coalesce(now - F.greatest(*beats) < ttl_ms, F.lit(False))


def djb2_xor(text: Column, most: int = 65_536) -> Column:
    """Rolling hash h * 33 ^ byte of the first 64 KB of code points below 256, as unsigned 32 bits."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, most), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: ((h * 33).bitwiseAND(F.lit(4294967295))).bitwiseXOR(c))
