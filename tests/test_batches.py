"""Ranges of pages: a plain fold, tiling as an invariant, and the stream."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import batches, chunking
from tessella.operators.batches import Batches, Ranges

KINDS = ["plan", "claim", "claim", "claim", "heartbeat", "done", "fail", "fail"]


def tiles(ranges, n):
    at = 1
    for first in sorted(ranges):
        assert first == at and ranges[first].last >= first
        at = ranges[first].last + 1
    assert at == n + 1 or not ranges


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 333), st.lists(st.tuples(st.sampled_from(KINDS[1:]), st.sampled_from([0, 5_000, 100_000, 180_000]), st.integers(0, 40)), max_size=60))
def test_ranges_tile_the_document(n, log):
    b, ts = Batches(Ranges()), 0
    b.step("plan", 0, n)
    for kind, wait, k in log:
        ts += wait
        firsts = b.ranges.firsts()
        b.step(kind, ts, firsts[k % len(firsts)] if firsts else k)
        tiles(b.ranges, n)
    assert all(r.last - a + 1 <= batches.SIZE for a, r in b.ranges.items())
    assert all(r.status != "failed" or r.last - a + 1 <= batches.LEAST for a, r in b.ranges.items())


def plain(rows, as_of=None):
    """{(project, lang, first): (last, status, attempts)}, with ranges as a sorted list."""
    out = {}
    for key in sorted({r[:2] for r in rows}):
        own, n = [], None

        def split(k):
            a, z, *_ = own[k]
            size = max(10, (z - a + 1) // 2)
            own[k : k + 1] = [[x, min(x + size - 1, z), "pending", 0, 0] for x in range(a, z + 1, size)] if z - a >= 10 else [[a, z, "failed", *own[k][3:]]]

        def recover(ts):
            for r in list(own):
                if r[2] == "running" and ts - r[4] >= 180_000:
                    if r[3] >= 2 and r[1] - r[0] >= 10:
                        split(own.index(r))
                    else:
                        r[2] = "pending"

        log = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        for *_, ts, kind, first in log:
            recover(ts)
            if kind == "plan" and not own:
                own = [[a, min(a + 49, first), "pending", 0, 0] for a in range(1, first + 1, 50)]
            elif kind == "claim":
                for r in own:
                    if r[2] == "pending":
                        r[2:] = ["running", r[3] + 1, ts]
                        break
            else:
                for k, r in enumerate(own):
                    if r[0] == first and r[2] == "running":
                        if kind == "heartbeat":
                            r[4] = ts
                        elif kind == "done":
                            r[2] = "done"
                        elif kind == "fail":
                            split(k)
                        break
        recover(log[-1][3] if as_of is None else as_of)
        out |= {(*key, a): (z, s, n) for a, z, s, n, _ in own}
    return out


def log(seed, keys=3, n=60):
    rng, rows = random.Random(seed), []
    for p in range(keys):
        ts = 1_704_000_000_000
        rows.append((p, "de", -1, ts, "plan", rng.choice([7, 120, 333])))
        for k in range(n):
            ts += rng.choice([1_000, 20_000, 90_000])
            rows.append((p, "de", k, ts, rng.choice(KINDS), rng.choice([1, 11, 13, 26, 51, 76, 101, None])))
    return rows


def as_map(rows):
    return {(r.project_id, r.lang, r["first"]): (r["last"], r.status, r.attempts) for r in rows}


def test_batch_and_stream_equal_a_plain_fold(spark, tmp_path):
    rows = log(3)
    df = spark.createDataFrame(rows, batches.EVENTS).repartition(4)
    assert as_map(batches.fold_batches(df).collect()) == plain(rows)
    assert batches.fold_batches(df.limit(0)).count() == 0
    end = max(r[3] for r in rows) + 400_000
    rows.append((0, "de", 10_000, end, "heartbeat", 10_000))
    ordered = sorted(rows, key=lambda r: (r[3], r[0], r[2]))
    seen = {}
    for n in range(3):
        spark.createDataFrame(ordered[len(ordered) * n // 3 : len(ordered) * (n + 1) // 3], batches.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = batches.batch_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "0 seconds")
        q = stream.writeStream.foreachBatch(lambda b, _: [seen.setdefault((r.project_id, r.lang, r["first"]), []).append(r) for r in b.collect()] and None)
        q = q.option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    wanted = plain(rows, end)
    assert as_map([max(v, key=lambda r: r.version) for v in seen.values()]) == wanted
    assert {s for _, s, _ in wanted.values()} >= {"done", "failed"}


def test_halves_are_those_of_columns(spark):
    for size in (11, 13, 25, 50):
        b = Batches(Ranges({1: batches.Range(size, "running", 1, 0)}))
        b.halve(1, b.ranges[1])
        parts = spark.range(1).select(chunking.shrink_batch(F.lit(1), F.lit(size), F.lit(size)).alias("p")).first().p
        assert [(r["first"], r["last"]) for r in parts] == [(a, b.ranges[a].last) for a in b.ranges.firsts()]
