"""The work queue as a stream: the same step function as the batch fold, as keyed state.

A project's jobs are entries of a map state, so a batch reads and writes the jobs
that its events name and no others, and only rows that have changed leave.  A lease
and a retry each have a timer: in event time it fires when the watermark has passed
it, in processing time (the watchdog) by the clock, also for projects that fell silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.operators.jobs import EVENTS, STATE, Job, Queue, as_frame, job_row, project_row, take
from tessella.operators.reports import latest_per

KEY = "lang string, chunk_index int"
JOB = "status string, token string, beat long, attempts int, reclaimed int, due long, n_chars long, pair_failures int, retried boolean, version long"
SHARED = "ring array<long>, day string, today int, streak int, workers int, stale int, refused int, tripped array<string>, last long, version long"


class StoredJobs:
    """Jobs in a map state, read when they are looked at and written if they have changed."""

    def __init__(self, state) -> None:
        self.state, self.read, self.versions, self.seen = state, {}, {}, {}

    def get(self, key: tuple) -> Job | None:
        if key not in self.seen:
            if key[0] is None or key[1] is None or not self.state.containsKey(key):
                return None
            *own, self.versions[key] = self.state.getValue(key)
            self.seen[key] = Job(*own)
            self.read[key] = astuple(self.seen[key])
        return self.seen[key]

    def put(self, key: tuple, job: Job) -> None:
        self.seen[key] = job

    def items(self) -> list[tuple[tuple, Job]]:
        for key in [tuple(k) for k in self.state.keys()]:
            self.get(key)
        return list(self.seen.items())

    def written(self) -> list[tuple[tuple, Job]]:
        changed = [(key, job) for key, job in self.seen.items() if astuple(job) != self.read.get(key)]
        for key, job in changed:
            self.versions[key] = self.versions.get(key, 0) + 1
            self.state.updateValue(key, (*astuple(job), self.versions[key]))
        return changed


class QueueProcessor(StatefulProcessor):
    """Folds each batch's events of a project, in order, into its state; emits the jobs that have changed, and the project if it has."""

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", KEY, JOB)
        self.shared = handle.getValueState("project", SHARED)
        #: The jobs that a timer is for.
        self.due = handle.getMapState("due", "at long", "jobs array<struct<lang:string,chunk_index:int>>")

    def _load(self) -> tuple[Queue, tuple | None]:
        q, before = Queue(StoredJobs(self.jobs)), None
        if self.shared.exists():
            ring, q.day, q.today, q.streak, q.workers, q.stale, q.refused, tripped, q.last, _ = before = tuple(self.shared.get())
            q.ring, q.tripped = list(ring), list(tripped)
        return q, before

    def _store(self, project: int, q: Queue, before: tuple | None) -> pd.DataFrame:
        changed = q.jobs.written()
        if self.timers:
            at: dict[int, list] = {}
            for key, job in changed:
                if (deadline := job.deadline()) is not None:
                    at.setdefault(deadline, []).append(key)
            for deadline, keys in at.items():
                known = [tuple(k) for k in self.due.getValue((deadline,))[0]] if self.due.containsKey((deadline,)) else []
                self.due.updateValue((deadline,), (sorted({*known, *keys}),))
                self.handle.registerTimer(deadline)
        rows = [job_row(project, key, job, q.jobs.versions[key]) for key, job in sorted(changed, key=lambda c: c[0])]
        told = before is None or (before[4], before[5], before[6], list(before[7])) != (q.workers, q.stale, q.refused, q.tripped)
        version = (before[-1] if before else 0) + told
        self.shared.update((q.ring, q.day, q.today, q.streak, q.workers, q.stale, q.refused, q.tripped, q.last, version))
        return as_frame([*rows, project_row(project, q, version)] if told else rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q, before = self._load()
        take(q, pd.concat(list(rows)).sort_values(["ts_ms", "event_id"]))
        yield self._store(key[0], q, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q, before = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.containsKey((at,)):
            for own in self.due.getValue((at,))[0]:
                # A heartbeat may have put the end off; then a later timer is set already.
                q.job(tuple(own), at)
            self.due.removeKey((at,))
        yield self._store(key[0], q, before)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, timers: str = "none", late: str = "10 minutes") -> DataFrame:
    """Stream of changed states (``STATE``) from a stream of events.  Needs the RocksDB state store.

    ``timers`` is "none" (jobs lapse when an event looks at them), "eventTime" (also when the watermark, ``late``
    behind the events, passes their deadline) or "processingTime".
    """
    own = events.select(*(f.split()[0] for f in EVENTS.split(", ")))
    if timers == "eventTime":
        own = own.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return own.groupBy("project_id").transformWithStateInPandas(QueueProcessor(timers != "none"), STATE, "update", timers)


def idempotent(events: DataFrame, key: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark goes."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(key)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


class LiveView:
    """Each row's latest version as a table in ``folder``: a snapshot and the changes since, merged every ``most`` batches.

    The current state of the view is a file ``versions/<batch>`` that names the snapshot and the changes after it.
    It is written last and never altered, so a reader sees one batch or the next.  A batch that is replayed before
    that writes the same folders again; one that is replayed after it is left out.  What neither this file nor the
    one before it names is removed, so the number of folders stays bounded, and a reader has a batch's time to finish.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 20) -> None:
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _parts(self, batch: int) -> list[str]:
        return self.spark.read.text(f"{self.folder}/versions/{batch}").first()[0].split(",")

    def put(self, rows: DataFrame, batch: int) -> None:
        known = self._names("versions")
        if known and batch <= known[-1]:
            return
        before = self._parts(known[-1]) if known else []
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes/{batch}")
        parts = [*before, f"changes/{batch}"]
        if len(parts) > self.most:
            self._latest(parts).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{batch}")
            parts = [f"snapshots/{batch}"]
        self.spark.createDataFrame([(",".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/versions/{batch}")
        kept = {*before, *parts, f"versions/{batch}", *(f"versions/{n}" for n in known[-1:])}
        for old in (f"{kind}/{n}" for kind in ("changes", "snapshots", "versions") for n in self._names(kind)):
            if old not in kept:
                self._fs.delete(self._path(f"{self.folder}/{old}"), True)

    def _latest(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*(f"{self.folder}/{p}" for p in parts))
        return latest_per(rows, ["project_id", "lang", "chunk_index"], [F.desc("version")])

    def states(self) -> DataFrame:
        """The latest state of every job and project (``STATE``)."""
        known = self._names("versions")
        return self._latest(self._parts(known[-1])) if known else self.spark.createDataFrame([], STATE)


def live_view(states: DataFrame, name: str, checkpoint: str, most: int = 20) -> StreamingQuery:
    """Keeps a ``LiveView`` up to date from a stream of states."""
    view = LiveView(states.sparkSession, f"{checkpoint}/{name}", most)
    return states.writeStream.foreachBatch(view.put).option("checkpointLocation", f"{checkpoint}/{name}-checkpoint").outputMode("update").trigger(availableNow=True).start()


def hourly_sweep(view: LiveView) -> DataFrame:
    """(project_id, open, failed, reviews) from the live view, for a job that an hour's turn starts; it reads the view and no state store."""
    jobs, status = view.states().where("lang IS NOT NULL"), F.col("status")
    return jobs.groupBy("project_id").agg(F.count_if(status.isin("pending", "claimed", "retry_wait")).alias("open"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "needs_review").alias("reviews"))
