"""The queue as a batch fold and as a stream, against a plain fold over random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, jobs
from tessella.streaming.queue import LiveView, hourly_sweep, job_states, live_view

KINDS = ["enqueue", "enqueue", "claim", "claim_pair", "claim_pair", "heartbeat", "ok", "fail", "http429", "pair_split", "pair_split", "contract_retry", "review", "resolve", "release"]


def random_log(seed, projects=3, n=150):
    rng = random.Random(seed)
    rows = []
    for p in range(projects):
        ts = 1_704_000_000_000
        # A language whose pairs fail twice.
        start = ["enqueue", "enqueue", "claim_pair", "pair_split", "claim_pair", "pair_split", "claim_pair"]
        rows += [(p, k - 10, ts + 9 * k, kind, "fr", int(k == 1), "a", None, 10) for k, kind in enumerate(start)] if p == 0 else []
        for k in range(n):
            ts += rng.choice([0, 500, 3_000, 9_000, 200_000])
            kind = rng.choice(KINDS) if k != n // 2 or p else "cancel"
            rows.append((p, k, ts, kind, rng.choice(["de", "fr"]), rng.randrange(4), rng.choice("ab"), rng.choice([None, 90_000]), rng.choice([None, 10, 9_000])))
    return rows


def plain_fold(rows, as_of=None):
    """(status, attempts, reclaimed, pair failures, retried) of jobs and (workers, stale, refused, tripped) of projects; every job lapses at every event."""
    out = {}
    for p in sorted({r[0] for r in rows}):
        own, ring, workers, streak, stale, refused, tripped = {}, [], 2, 0, 0, 0, set()

        def lapse(ts):
            for j in own.values():
                if j["s"] == "claimed" and ts - j["beat"] >= 180_000:
                    j.update(s="pending", token=None, r=j["r"] + 1)
                elif j["s"] == "retry_wait" and j["due"] <= ts:
                    j["s"] = "pending"

        for _, _, ts, kind, lang, i, token, after, chars in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1])):
            lapse(ts)
            job, other = own.get((lang, i)), own.get((lang, i + 1))
            if kind == "enqueue":
                own.setdefault((lang, i), dict(s="pending", token=None, beat=0, a=0, r=0, due=0, c=chars or 0, f=0, strict=False))
            elif kind in ("claim", "claim_pair") and job and job["s"] == "pending":
                ring = [t for t in ring if ts - t < 60_000]
                if len(ring) >= 10:
                    refused += 1
                    continue
                ring.append(ts)
                both = kind == "claim_pair" and lang not in tripped and other and other["s"] == "pending" and jobs.pair_tokens(job["c"], other["c"]) <= 6_000
                for j in [job] + [other] * bool(both):
                    j.update(s="claimed", token=token, beat=ts)
            elif kind == "release":
                ring = ring[:-1]
            elif kind == "cancel":
                for j in own.values():
                    j["s"] = j["s"] if j["s"] in ("done", "failed") else "cancelled"
            elif kind == "resolve" and job and job["s"] == "needs_review":
                job.update(dict(s="done") if chars else dict(s="pending", strict=False))
            elif kind in ("heartbeat", "ok", "fail", "http429", "pair_split", "contract_retry", "review") and job:
                if job["s"] != "claimed" or job["token"] != token:
                    stale += 1
                elif kind == "heartbeat":
                    job["beat"] = ts
                elif kind == "ok":
                    job["s"], streak = "done", 0
                elif kind in ("fail", "http429"):
                    job["a"] += 1
                    streak += kind == "http429"
                    if kind == "http429":
                        workers = max(1, workers - 1) if streak >= 3 else workers
                        workers = max(1, workers // 2) if streak >= 4 else workers
                    job.update(s="failed") if job["a"] >= 10 else job.update(s="retry_wait", due=ts + max(min(120_000, 2_000 * 2 ** (job["a"] - 1)), after or 0))
                elif kind == "pair_split":
                    for j in [job] + [other] * bool(other and other["s"] == "claimed" and other["token"] == token):
                        j.update(s="pending", token=None)
                    job["f"] += 1
                    tripped |= {lang} if job["f"] >= 2 else set()
                elif kind == "contract_retry":
                    job["strict"] = True
                else:
                    job.update(s="needs_review", token=None)
        lapse(max(r[2] for r in rows if r[0] == p) if as_of is None else as_of)
        out |= {(p, *k): (j["s"], j["a"], j["r"], j["f"], j["strict"]) for k, j in own.items()}
        out[p, None, None] = (workers, stale, refused, tuple(sorted(tripped)))
    return out


def states(rows):
    return {(r.project_id, r.lang, r.chunk_index): (r.workers, r.stale, r.refused, tuple(r.tripped)) if r.lang is None else (r.status, r.attempts, r.reclaimed, r.pair_failures, r.retried) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_plain_fold(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, jobs.EVENTS).repartition(5)
    assert states(jobs.fold_jobs(df).collect()) == plain_fold(rows)
    late = max(r[2] for r in rows) + 10**9
    found = plain_fold(rows, late)
    assert states(jobs.fold_jobs(df, late).collect()) == found
    assert any(v[-1] for k, v in found.items() if k[1] is None) and {v[0] for k, v in found.items() if k[1]} >= {"pending", "done"}
    assert jobs.fold_jobs(df.limit(0)).count() == 0


def run(spark, rows, folder, parts, timers, most=3):
    """The view of a stream that gets a log in parts, by time."""
    schema = spark.createDataFrame([], jobs.EVENTS).schema
    ordered = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    query = None
    for n in range(parts):
        own = ordered[len(ordered) * n // parts : len(ordered) * (n + 1) // parts]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = live_view(job_states(stream, timers, "0 seconds"), "view", str(folder), most)
        query.awaitTermination(180)
        assert query.exception() is None
    return LiveView(spark, f"{folder}/view", most), query


def test_stream_equals_batch_with_its_timers(spark, tmp_path):
    rows = random_log(7, 2, 60)
    # The watermark ends where the last event does, and so do leases.
    end = max(r[2] for r in rows) + 500_000
    rows.append((0, 1_000, end, "enqueue", "de", 9, None, None, None))
    view, query = run(spark, rows, tmp_path, 4, "eventTime")
    found = states(view.states().collect())
    assert found == plain_fold(rows, end)
    sizes = [query.lastProgress.stateOperators[0].numRowsTotal]
    assert sizes[0] > 0
    sweep = {r.project_id: (r.open, r.failed, r.reviews) for r in hourly_sweep(view).collect()}
    for p in (0, 1):
        own = [v[0] for k, v in found.items() if k[0] == p and k[1]]
        assert sweep[p] == (sum(s in ("pending", "claimed", "retry_wait") for s in own), own.count("failed"), own.count("needs_review"))


def test_view_stays_bounded_and_replays_change_nothing(spark, tmp_path):
    view = LiveView(spark, str(tmp_path / "v"), 3)
    assert view.states().count() == 0
    row = lambda k, v: (1, "de", k, "done", v, 0, 0, False, None, None, None, None, v)
    for n in range(15):
        batch = spark.createDataFrame([row(n % 5, n), row(n % 2, n)] if n % 5 != n % 2 else [row(n % 5, n)], jobs.STATE)
        view.put(batch, n)
        if n % 4 == 0:
            view.put(spark.createDataFrame([row(0, 99)], jobs.STATE), n)  # a replay: left out
    wanted = {k: max(n for n in range(15) if n % 5 == k or n % 2 == k) for k in range(5)}
    assert {r.chunk_index: r.version for r in view.states().collect()} == wanted
    assert sum(1 for kind in ("changes", "snapshots", "versions") for _ in (tmp_path / "v" / kind).iterdir()) <= 12


def test_pair_tokens_are_those_of_columns(spark):
    sizes = [(a, b) for a in (0, 1, 599, 8_000, 19_140) for b in (0, 3, 1_200)]
    df = spark.createDataFrame(sizes, "a long, b long").select("a", "b", chunking.safe_pair_tokens(F.col("a"), F.col("b")).alias("t"))
    assert all(r.t == jobs.pair_tokens(r.a, r.b) for r in df.collect())
