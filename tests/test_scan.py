"""Parallel scans against plain loops, with one key that has most rows and buckets of very different sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, jobs, reports, scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    keys = ["hot"] * 60 + ["a", "b", None]
    made = [(rng.choice(keys), k, rng.randrange(5), rng.choice(["x", None, "y"])) for k in rng.sample(range(3_000), 400)]
    return made + [(None, k, 1, "z") for k in range(3_000, 3_004)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_running_and_neighbours(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, at long, v int, s string").repartition(5)
    bucket = scan.bucket_of(F.col("at"), width)
    got = {r.at: (r.total, r.odd) for r in scan.running(df, ["k"], bucket, ["at"], total=F.col("v"), odd=F.col("v") % 2).collect()}
    before = {r.at: (r.s0, r.at0) for r in scan.neighbour(df, ["k"], bucket, ["at"], {"s0": "s", "at0": "at"}).collect()}
    after = {r.at: r.at0 for r in scan.neighbour(df, ["k"], bucket, ["at"], {"at0": "at"}, ahead=True).collect()}
    assert len(got) == len(before) == len(after) == len(rows)
    for own in by_key(rows).values():
        for i, r in enumerate(own):
            assert got[r[1]] == (sum(x[2] for x in own[: i + 1]), sum(x[2] % 2 for x in own[: i + 1]))
            assert before[r[1]] == ((own[i - 1][3], own[i - 1][1]) if i else (None, None)) and after[r[1]] == (own[i + 1][1] if i + 1 < len(own) else None)


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_folds_compose(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, at long, v int, s string").repartition(5)
    step = lambda s, v: (s * 3 + v * v) % 7 if v else np.maximum(s - 2, 0)
    got = {r.at: (r.before, r.after, r.s) for r in scan.folded(df, ["k"], scan.bucket_of(F.col("at"), width), ["at"], "v", 7, step, 2).collect()}
    for own in by_key(rows).values():
        state = np.array([2])
        for r in own:
            new = step(state, r[2])
            assert got[r[1]] == (int(state[0]), int(new[0]), r[3])
            state = new
    assert scan.folded(df.limit(0), ["k"], scan.bucket_of(F.col("at"), width), ["at"], "v", 7, step).count() == 0


@pytest.mark.parametrize("width", [1, 500, 10**9])
def test_streaks_and_worker_limits(spark, width):
    rng = random.Random(8)
    log = [(rng.choice([1, 1, 1, 2]), k, rng.randrange(4_000), rng.choice(["http429"] * 5 + ["ok", "fail"])) for k in range(300)]
    df = spark.createDataFrame(log, "project_id long, event_id long, ts_ms long, kind string").repartition(4)
    got = {r.event_id: (r.streak, r.workers) for r in jobs.streak_429(df, 9, width).collect()}
    wanted, state = {}, {}
    for p, e, _, kind in sorted(log, key=lambda r: (r[2], r[1])):
        streak, workers = state.get(p, (0, 9))
        if kind == "http429":
            streak += 1
            workers = max(1, workers - 1) if streak >= 3 else workers
            workers = max(1, workers // 2) if streak >= 4 else workers
            wanted[e] = (streak, workers)
        state[p] = (0 if kind == "ok" else streak, workers)
    assert got == wanted and len({w for _, w in got.values()}) > 3


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_page_ranges_and_tails_of_a_hot_source(spark, width):
    rng = random.Random(2)
    pages = [(s, p, rng.choice([0, 1, 3, 9, 25])) for s, n in (("hot", 300), ("b", 3), ("c", 1)) for p in range(n)]
    got = {(r.source, r.range_idx): (r.first, r.last) for r in chunking.ranges_of_pages(spark.createDataFrame(pages, "source string, page long, words int").repartition(3), 20, width).collect()}
    wanted, now = {}, {}
    for s, p, w in pages:
        idx, first, words = now.get(s, (-1, None, 0))
        if first is None or words + w > 20:
            idx, first, words = idx + 1, p, 0
        now[s] = (idx, first, words + w)
        wanted[s, idx] = (first, p)
    assert got == wanted
    chunks = [("p", "de", i, f"One {i}. Two {i}! Three {i}?" if i % 3 else f"only {i}", "done" if i % 4 else "pending") for i in range(60)]
    df = spark.createDataFrame(chunks, "project_id string, lang string, chunk_index long, text string, status string")
    tails = {r.chunk_index: r.context for r in reports.previous_tail(df, width=width).collect()}
    tail = lambda i: None if i < 0 or i % 4 == 0 else f"Two {i}! Three {i}?" if i % 3 else f"only {i}"
    assert tails == {i: tail(i - 1) for i in range(60)}
    pairs = {r.chunk_index: r.next_index for r in chunking.neighbour_pairs(df.withColumn("n_chars", F.length("text")), width=width).collect()}
    assert pairs == {}
    open_ = df.where("chunk_index <> 7").withColumn("n_chars", F.length("text")).withColumn("status", F.lit("pending"))
    assert {r.chunk_index: r.next_index for r in chunking.neighbour_pairs(open_, width=width).collect()} == {i: i + 1 for i in range(59) if i not in (6, 7)}
