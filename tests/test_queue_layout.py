import random

from pyspark.sql import functions as F

from tessella.operators import jobs, layout, reports
from tessella.plans.translate import localize
from tessella.sources import exports


def log(spark, rows):
    return spark.createDataFrame([(1, k, ts, kind, "de", i, token, None, None) for k, (ts, kind, i, token) in enumerate(rows)], jobs.EVENTS)


def states(spark, rows):
    return {r.chunk_index: r for r in jobs.fold_jobs(log(spark, rows)).collect()}  # None: the project


def test_limiter_admits_ten_and_its_window_is_strict(spark):
    times = [i * 2_000 for i in range(12)] + [60_000]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "project_id long, event_id long, ts_ms long")
    got = [r.verdict for r in jobs.admitted(df).orderBy("event_id").collect()]
    assert got == ["ok"] * 10 + ["rpm"] * 2 + ["ok"]


def test_daily_budget_resets_at_pacific_midnight(spark):
    midnight = 1_704_096_000_000  # 2024-01-01 08:00 UTC
    times = [midnight - 3_600_000 * k for k in (3, 2, 1)] + [midnight, midnight + 3_600_000]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "project_id long, event_id long, ts_ms long")
    assert [r.verdict for r in jobs.admitted(df, daily=2).orderBy("event_id").collect()] == ["ok", "ok", "daily", "ok", "ok"]


def test_leases_tokens_and_retries(spark):
    got = states(spark, [(0, "enqueue", 0, None), (0, "enqueue", 0, None), (1, "claim", 0, "a"), (2, "claim", 0, "b"), (3, "ok", 0, "b"), (4, "ok", 0, "a")])
    assert got[0].status == "done" and got[None].stale == 1 and len(got) == 2
    got = states(spark, [(0, "enqueue", 0, None), (1, "claim", 0, "a"), (180_001, "claim", 0, "b"), (180_002, "ok", 0, "a"), (180_003, "fail", 0, "b")])
    assert (got[0].status, got[0].attempts, got[0].reclaimed, got[None].stale) == ("retry_wait", 1, 1, 1)
    rows, t = [(0, "enqueue", 0, None)], 0
    for _ in range(10):
        t += 200_000
        rows += [(t, "claim", 0, "x"), (t + 1, "http429", 0, "x")]
    got = states(spark, rows)
    assert (got[0].status, got[None].workers) == ("failed", 1)


def test_kerned_items_hyphens_and_blocks(spark):
    items = [("Lo", 50.0, 700.0, 10.0), ("cal", 60.5, 700.0, 15.0), ("text", 80.0, 701.0, 20.0), ("some-", 50.0, 684.0, 20.0), ("thing", 50.0, 668.0, 20.0), ("Next", 50.0, 620.0, 20.0)]
    df = spark.createDataFrame([(1, 1, k, s, x, y, w, 10.0) for k, (s, x, y, w) in enumerate(items)], "doc_id long, page int, item_idx int, str string, x double, y double, width double, height double")
    lines = [r.text for r in layout.merge_lines(df).orderBy("line_idx").collect()]
    assert lines == ["Local text", "something", "Next"]
    blocks = layout.items_to_blocks(df).orderBy("block_idx").collect()
    assert [b.text for b in blocks] == ["Local text\nsomething", "Next"]
    fitted = layout.fit_blocks(layout.items_to_blocks(df)).collect()
    assert all(6 <= f["size"] <= 16 for f in fitted)


def plain_map(paragraphs, blocks):
    words = lambda s: len(s.split())
    if len(paragraphs) == len(blocks):
        return paragraphs
    weight = [max(words(b), 1) for b in blocks]
    total, out, at = max(sum(map(words, paragraphs)), 1), [], 0
    for k, w in enumerate(weight):
        target, buf, n, last = w / sum(weight) * total, [], 0, k == len(blocks) - 1
        while at < len(paragraphs) and (n + words(paragraphs[at]) <= target + 0.5 or last):
            buf.append(paragraphs[at])
            n += words(paragraphs[at])
            at += 1
            if not last and n >= target:
                break
        out.append("\n\n".join(buf))
    return out


def test_paragraphs_are_dealt_to_blocks(spark):
    rng = random.Random(6)
    make = lambda n: [" ".join("w" * rng.randint(1, 9)) for _ in range(rng.randint(1, n))]
    cases = [(make(8), make(5)) for _ in range(150)]
    got = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(cases)], "i int, p array<string>, b array<string>").select("i", layout.map_paragraphs(F.col("p"), F.col("b")).alias("o")).collect()
    for r in got:
        assert r.o == plain_map(*cases[r.i])


def test_export_faults_and_gate(spark):
    fault = lambda j: spark.createDataFrame([(j,)], "j string").select(exports.import_fault(F.col("j"))).first()[0]
    assert fault("nonsense") == "not an export"
    assert fault('{"type": "other", "version": 2}') == "wrong type"
    assert fault('{"type": "project_export", "version": 1}') == "wrong version"
    assert fault('{"type": "project_export", "version": 2, "project": {"name": "x"}, "chunks": []}') is None
    edges = reports.import_edges(spark.createDataFrame([("a/x.ts", ["./y", "react"]), ("a/y.ts", [])], "path string, imports array<string>")).collect()
    assert [(e.path, e.target) for e in edges] == [("a/x.ts", "a/y.ts")]


def test_localize_merges_in_order_and_isolates_failures(spark):
    docs = spark.createDataFrame([(1, "One two.\n\nThree four.\n\nFive six."), (2, "bad")], "doc_id long, text string")

    def translator(p, s, lang):
        if s == "bad":
            raise RuntimeError
        return s.upper()

    checked, merged = localize(docs, ["fr"], translator, most=2)
    assert {r.project_id: r.text for r in merged.collect()} == {1: "ONE TWO.\n\nTHREE FOUR.\n\nFIVE SIX."}
    assert checked.where("status = 'failed'").count() == 1


def test_wrapping_by_advances_equals_plain_wrapping(spark):
    rng = random.Random(9)
    advances = {"a": 250, "b": 900, "W": 1_700, " ": 333, "é": 0}
    width = lambda t: sum(advances.get(c, 500) for c in t)
    for _ in range(3_000):
        text = "".join(rng.choice("aabbWéx   \n") for _ in range(rng.randint(0, 40)))
        most = rng.choice([100, 500, 1_700, 2_600, 4_000, 9_999.5])
        own = layout.Paragraphs(text, advances)
        assert [own.text_of(x) for x in own.lines(most)] == layout.wrapped(text, most, width), (text, most)
    blocks = [(1, 1, k, "".join(rng.choice("abW x\n") for _ in range(rng.randint(1, 90))), float(rng.randint(20, 200)), float(rng.randint(5, 80)), 12.0) for k in range(60)]
    df = spark.createDataFrame(blocks, "doc_id long, page int, block_idx int, text string, width double, height double, font_size double")
    by_metric = layout.fit_blocks(df, lambda t, size: width(t) * size / 1_000).collect()
    assert sorted(map(tuple, by_metric)) == sorted(map(tuple, layout.fit_blocks(df, advances=advances).collect()))
