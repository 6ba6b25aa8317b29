"""Queries that no SQL expresses, against plain Python over the whole smallest tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from tessella.functions import rules
from tessella.functions import text as T
from tessella.operators import quality
from tessella.plans import bindings as B
from tessella.plans import queries
from tessella.sources import documents

from tests.test_batches import plain as plain_batches
from tests.test_queue_stream import plain_fold

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the sample tables are not here")
SPACE = r"[ \t\n\x0B\f\r]"


def rows_of(spark, name):
    return queries.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in documents.load(spark, DATA, "documents").collect()]


@pytest.fixture(scope="module")
def pairs(spark):
    return [r.asDict() for r in B.pairs(spark, DATA).collect()]


def words(text):
    return [w for w in re.split(f"{SPACE}+", text) if w]


def trim(text):
    return text.strip(" \t\n\x0b\f\r")


def half_up(x):
    return math.floor(x + 0.5)


def test_rtl_runs(spark, docs):
    letters = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
    plain = lambda t: "".join(run[::-1] if re.match(f"[{letters}]", run) else run for run in re.findall(f"[{letters}]+|[^{letters}]+", t.translate(str.maketrans("aeiou", "ابتثج"))))
    assert {r.doc_id: r.digest for r in rows_of(spark, "rtl_runs")} == {d["doc_id"]: hashlib.md5(plain(d["text"]).encode()).hexdigest() for d in docs}


def test_word_windows(spark, docs):
    def windows(text, most):
        own, at, n = re.split(f"{SPACE}+", text), 0, 0
        while at < len(own):
            end = min(at + most, len(own))
            if end < len(own):
                end = next((j + 1 for j in range(end - 1, -1, -1) if j > at + most * 0.7 and re.search("[.!?…]$", own[j])), end)
            at, n = end, n + 1
        return max(1, n)

    assert {r.doc_id: (r.words, r.windows) for r in rows_of(spark, "word_windows")} == {d["doc_id"]: (len(words(d["text"])), windows(d["text"], 200)) for d in docs}


def packed(units, most, joiner):
    out, now, n = [], "", 0
    for u in units:
        w = len(words(u))
        if now and n + w > most:
            out, now, n = [*out, now], "", 0
        now, n = (f"{now}{joiner}{u}" if now else u), n + w
    return [*out, now] if now else out


def plain_chunks(text, most, variant):
    out, run = [], []
    for p in [trim(x) for x in (text.replace("\r\n", "\n") if variant == "batch" else text).split("\n")]:
        if not p:
            continue
        if len(words(p)) <= most:
            run.append(p)
            continue
        out, run = out + packed(run, most, "\n\n"), []
        if variant == "batch":
            ends = rf"[^.!?۔。！？]+[.!?۔。！？]+[\"'»」』]?{SPACE}*|[^.!?۔。！？]+$"
            out += [c for c in map(trim, packed(re.findall(ends, p), most, "")) if c]
        else:
            out += packed(re.split(rf"(?<=[.!?。！？]){SPACE}+", p), most, " ")
    return out + packed(run, most, "\n\n")


def test_chunk_counts(spark, docs):
    count = lambda c: (len(c), sum(len(words(x)) for x in c))
    wanted = {d["doc_id"]: (*count(a), *count(b)) for d in docs if (a := plain_chunks(d["text"], 100, "job")) and (b := plain_chunks(d["text"], 100, "batch"))}
    assert {r.doc_id: (r.job_chunks, r.job_words, r.batch_chunks, r.batch_words) for r in rows_of(spark, "chunk_counts")} == wanted


def latin(text):
    return [w.lower() for w in re.findall("[A-Za-z]+(?:['’-][A-Za-z]+)*", text)]


def qa_words(text):
    own = re.sub("[​-‏‪-‮⁦-⁩﻿]", "", text)
    own = re.sub(rf"^(?:{SPACE}|[^\w\s])+|(?:{SPACE}|[^\w\s])+$", "", own)
    return len(words(own))


def plain_phases(pair, tables):
    """{phase: status} of a pair in one of the languages of the sample."""
    s, o, lang = pair["source"], pair["output"], pair["lang"]
    rule = rules.BY_LANG[lang]
    script = rule[7]

    def ratio(matched, present):
        r = matched / present if present else 1
        return "pass" if r >= 0.8 else "warn" if r >= 0.5 else "fail"

    def terms(rows, exact=False):
        own = [(t, f) for code, t, f in rows if code == lang and re.search(rf"\b{re.escape(t)}\b", s, 0 if exact else re.I)]
        fuzzy = lambda f: f and (f.lower() in o.lower() or (len(f) >= 3 and f.lower()[: max(3, len(f) - 1)] in o.lower()))
        return sum(((f or t) in o) if exact else bool(fuzzy(f)) for t, f in own), len(own)

    warn = lambda bad: "warn" if bad else "pass"
    sw, ow = latin(s), latin(o)
    quotes = lambda t: min(len(re.findall('["“„«「『]', t)), len(re.findall('["”»」』]', t)))
    explicit = bool(re.search(r"\b(?:" + "|".join(rules.EXPLICIT) + r")\b", o, re.I))
    issues = int(lang in rules.RTL and not re.search("[‏‫]", o)) + int(script != "Latin" and bool(ow))
    length = qa_words(o) / max(1, qa_words(s))
    low, high = (0.3, 1.5) if script in ("Chinese", "Japanese", "Hangul") else (0.4, 2.2) if script in ("Arabic", "Cyrillic", "Devanagari", "Bengali") else (0.5, 2.0)
    heads = lambda t: sum(bool(re.search("|".join(rules.CHAPTER_WORDS), line)) for line in t.lower().split("\n"))
    factor = 1.0 if script in ("Chinese", "Japanese", "Hangul") else 0.75 if script == "Arabic" else 0.6
    cjk = lambda line: len(re.findall("[　-ヿ㐀-鿿가-힯]", line))
    thoughts = "warn" if re.search(r"\*[^*]+\*", o) or abs(len(re.findall("[「『【]", o)) - len(re.findall("[」』】]", o))) > 1 else "pass"
    found = {
        1: ratio(*terms(tables["terms"])), 2: ratio(*terms(tables["names"], True)), 3: warn(bool(ow) and sum(w in sw for w in ow) / len(ow) > 0.6),
        4: warn(quotes(s) and abs(quotes(o) - quotes(s)) > max(1, half_up(quotes(s) * 0.6))), 6: warn(explicit), 8: ("pass", "warn", "fail")[issues], 9: ratio(*terms(tables["core"])),
        10: "pass" if abs(o.count(rule[1]) - o.count(rule[2])) <= 1 and len(re.findall("[\"']", o)) <= 2 else "warn", 13: warn(explicit), 14: warn(any(w in ow for w in rules.AVOID)), 15: ratio(*terms(tables["ranks"])),
        16: thoughts, 17: "pass" if low <= length <= high else "warn", 19: "pass" if not heads(s) or abs(heads(o) - heads(s)) <= max(1.0, heads(s) * 0.3) else "warn",
        21: warn((m := terms(tables["memory"]))[0] != m[1]), 22: warn(max(cjk(x) + (len(x) - cjk(x)) * factor for x in o.split("\n")) > 120),
    } | dict.fromkeys(quality.GATES, "pass")
    return found | {23: warn(any(v != "pass" for v in found.values()) or (script != "Latin" and ow))}


TABLES = {"terms": rules.TERMS, "names": rules.PEOPLE, "memory": rules.TERMS[:3], "core": rules.CORE_TERMS, "ranks": rules.RANKS}


@pytest.fixture(scope="module")
def phases(pairs):
    return {p["unit_id"]: plain_phases(p, TABLES) for p in pairs}


def rolled(checks):
    n = Counter(checks.values())
    score = max(0, min(100, half_up(100 - n["fail"] * 25 / len(checks) - n["warn"] * 8 / len(checks))))
    return n["pass"], n["warn"], n["fail"], score, "fail" if n["fail"] else "warn" if n["warn"] else "pass"


def test_qa_checks_and_rollup(spark, phases):
    got = defaultdict(dict)
    for r in rows_of(spark, "qa_checks"):
        assert r.phase not in got[r.unit_id]
        got[r.unit_id][r.phase] = r.status
    assert got.keys() == phases.keys()
    assert {(k, p): (s, phases[k][p]) for k, own in got.items() for p, s in own.items() if phases[k][p] != s} == {} and all(len(own) == 23 for own in got.values())
    assert {r.unit_id: (r.passes, r.warns, r.fails, r.score, r.overall) for r in rows_of(spark, "qa_rollup")} == {k: rolled(v) for k, v in phases.items()}
    assert len({s for own in phases.values() for s in own.values()}) > 1


def artifacts(text):
    return any(re.search(p.replace("(?i)", ""), text, re.I if p.startswith("(?i)") else 0) for _, p, _ in T.ARTIFACTS)


def plain_language(lang, source, output):
    t, rule = re.sub("[‎‏]", "", output), rules.BY_LANG[lang]
    cjk, foreign, blank = rule[3], rule[7] != "Latin", not trim(t)
    script = len(re.findall(f"[{rule[6]}]", t)) / max(1, len(t))
    ratio = (len(t) / len(source) if source else 0.0) if cjk else (len(words(t)) / len(words(source)) if words(source) else 0.0)
    letters = len(re.findall(r"[^\W\d_]+", t))
    own = [trim(p)[:80] for p in re.split(r"\n{2,}", t) if trim(p)]
    there = sum(bool(trim(p)) for p in re.split(r"\n{2,}", source))
    tests = [
        ("empty", blank), ("script_ratio", foreign and not blank and script < 0.5), ("english", foreign and not blank and len(re.findall(r"\b[A-Za-z]{3,}\b", t)) / max(1, letters) > 0.25),
        ("length_ratio", not blank and ratio > 0 and (ratio < 0.2 or ratio > 4 if cjk else ratio < 0.35 or ratio > 3.5)), ("source_echo", not blank and (rule[5] == "rtl" or foreign) and ratio > 0.4 and script < 0.3),
        ("delimiter_leak", bool(re.search(r"<<<\s*[A-Z]+_|SECTION_[AB]_", t))), ("artifacts", artifacts(t)), ("replacement", "�" in t),
        ("missing_paragraphs", there > 0 and len(own) < math.floor(there * 0.6)), ("duplicate_paragraphs", len(own) > len(set(own)) and len(own) > 2),
    ]
    return [name for name, bad in tests if bad]


def test_language_qa_and_reject_reasons(spark, pairs, phases):
    failed = {p["unit_id"]: plain_language(p["lang"], p["source"], p["output"]) for p in pairs}
    assert {r.unit_id: (r.failures, r.score) for r in rows_of(spark, "language_qa")} == {k: (",".join(f), max(0, 100 - 20 * len(f))) for k, f in failed.items()}

    def reason(p):
        o, k = p["output"], p["unit_id"]
        n, ascii_ = len(re.findall(r"[^\W\d_]", o)), len(re.findall("[A-Za-z]", o))
        if not trim(o):
            return "empty"
        if rules.BY_LANG[p["lang"]][7] != "Latin" and n >= 20 and n == ascii_:
            return "echo"
        return f"language:{failed[k][0]}" if failed[k] else "phases" if rolled(phases[k])[4] == "fail" else None

    assert {r.unit_id: r.reason for r in rows_of(spark, "reject_reasons")} == {p["unit_id"]: reason(p) for p in pairs}


def marked(text):
    head = text.split("\n")[:5]
    return sum(any(re.search(p.replace("(?i)", ""), line, re.I) for line in head) for p in quality.MARKERS) + ("```" in text)


def echoed(source, output):
    split = lambda t: [w for w in re.split("[ \t\n\r\f]+", re.sub("[^a-z \t\n\r\f]", " ", t.lower())) if w]
    s, o = split(source), set(split(output))
    at = range(0, max(len(s) - 8, 0) + 1, 4)
    return len(s) >= 24 and sum(all(w in o for w in s[i : i + 8]) for i in at) / len(at) > 0.25


def wrong(text, lang):
    if lang not in rules.TARGET_SCRIPTS:
        return False
    own = [c for c in text if c.isalpha() or not (c.isspace() or c.isdigit() or not c.isprintable() or re.match(r"[^\w]|_", c))]
    return len(own) >= 12 and len(re.findall(f"[{rules.TARGET_SCRIPTS[lang]}]", text)) / len(own) < 0.5


def test_contracts_and_pairs(spark, pairs):
    def reply(p):
        k, o = p["unit_id"], p["output"]
        reason = None
        if k % 4 == 0:
            reason = "invalid_json" if trim(o) else "empty_response"
        elif not trim(o):
            reason = "single_missing_or_empty_translation"
        elif k % 4 == 1:
            reason = "single_missing_selfCheck"
        elif marked(o):
            reason = f"markers_detected:{marked(o)}"
        elif echoed(p["source"], o):
            reason = "source_echo"
        elif wrong(o, p["lang"]):
            reason = f"wrong_language:{p['lang']}"
        return ("accept" if reason is None else "needs_review" if k % 3 == 0 else "retry_strict", reason)

    assert {r.unit_id: (r.action, r.reason) for r in rows_of(spark, "contract_replies")} == {p["unit_id"]: reply(p) for p in pairs}

    def verdict(p):
        if p["unit_id"] % 5 == 0:
            return "mismatch"
        texts = (p["output"], p["source"].upper())
        return "poisoned" if any(marked(t) or echoed(p["source"], t) or wrong(t, p["lang"]) for t in texts) else "ok"

    assert {r.unit_id: r.verdict for r in rows_of(spark, "pair_verdicts")} == {p["unit_id"]: verdict(p) for p in pairs}


def test_queue_and_batches(spark):
    log = [tuple(r) for r in queries.queue_events(spark, DATA).collect()]
    found = plain_fold(log)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows_of(spark, "job_fold")} == {k: v for k, v in found.items() if k[1]}
    assert {r.project_id: (r.workers, r.stale, r.refused, tuple(x for x in r.tripped.split(",") if x)) for r in rows_of(spark, "queue_projects")} == {k[0]: v for k, v in found.items() if k[1] is None}
    assert {r.lang: r.projects for r in rows_of(spark, "unpaired_languages")} == Counter(x for k, v in found.items() if k[1] is None for x in v[3])
    log = [tuple(r) for r in queries.batch_events(spark, DATA).collect()]
    assert {(r.project_id, r.lang, r["first"]): (r["last"], r.status, r.attempts) for r in rows_of(spark, "batch_ranges")} == plain_batches(log)


def test_uploads(spark):
    logs = defaultdict(list)
    for r in queries.upload_events(spark, DATA).collect():
        logs[r.upload_id].append(r)
    parts, states = {}, {}
    for k, log in logs.items():
        came, n, status, seq, beat = set(), 0, "uploaded", 0, None
        for r in sorted(log, key=lambda r: (r.ts_ms, r.event_id)):
            if r.kind == "start":
                n = r.part
            elif r.kind == "part":
                came.add(r.part)
            elif r.kind == "abort":
                came = set()
            elif r.kind == "stage" and r.expected == seq:
                status, seq, beat = r.stage, seq + 1, r.ts_ms
            elif r.kind == "fail" and status != "cancelled" and (r.expected is None or r.expected == seq):
                status, beat = "error", r.ts_ms
            elif r.kind == "cancel":
                status = "cancelled"
            elif r.kind == "heartbeat":
                beat = r.ts_ms
        missing = [p for p in range(1, n + 1) if p not in came]
        parts[k], states[k] = (n, n - len(missing), ",".join(map(str, missing)), next(iter(missing), None)), (status, seq, beat)
    assert {r.upload_id: (r.parts, r.received, r.missing, r.resume_at) for r in rows_of(spark, "received_parts")} == parts
    assert {r.upload_id: (r.status, r.stage_seq, r.heartbeat_at) for r in rows_of(spark, "upload_states")} == states
    assert {s for s, *_ in states.values()} >= {"error", "cancelled"} and any(p[2] for p in parts.values()) and any(p[3] is None for p in parts.values())


def plain_lines(items):
    """Lines (text, x, y, width, height, size) of a page's items."""
    groups, last = [], None
    for i in sorted((i for i in items if trim(i["str"])), key=lambda i: (-i["y"], i["item_idx"])):
        if last is None or abs(i["y"] - last) > 2:
            groups.append([])
        groups[-1].append(i)
        last = i["y"]
    lines = []
    for g in groups:
        g.sort(key=lambda i: (i["x"], i["item_idx"]))
        text, right = "", 0.0
        for i in g:
            near = i["x"] - right < 0.3 * max(i["height"], 1.0)
            text = text.rstrip(" ") + (" " if re.search(r"[ \t\n]$", text) or re.match(r"[ \t\n]", i["str"]) or not near else "") + i["str"].lstrip(" ") if text else i["str"]
            right = max(right, i["x"] + i["width"])
        size = [i["height"] if i["height"] > 0 else 10.0 for i in g]
        if trim(re.sub(" {2,}", " ", text)):
            lines.append([trim(re.sub(" {2,}", " ", text)), g[0]["x"], max(i["y"] for i in g), right - g[0]["x"], max(size), sum(size) / len(size)])
    out = []
    for k, line in enumerate(lines):
        if k and re.search("[a-z]-$", lines[k - 1][0]) and re.match("[a-z]", line[0]):
            first = out[-1]
            first[0] = re.sub("-$", "", first[0]) + line[0]
            first[3], first[5] = max(first[3], line[1] + line[3] - first[1]), max(first[5], line[5])
        else:
            out.append(list(line))
    return out


def plain_gap(lines):
    buckets = defaultdict(list)
    for a, b in zip(lines, lines[1:], strict=False):
        if 0.5 < a[2] - b[2] < 200:
            buckets[half_up((a[2] - b[2]) / 2)].append(a[2] - b[2])
    return sum(best := max(buckets.values(), key=lambda g: (len(g), -g[0]))) / len(best) if buckets else None


def plain_blocks(lines):
    gap, blocks = plain_gap(lines), []
    for k, line in enumerate(lines):
        far = k and gap and lines[k - 1][2] - line[2] > 1.5 * gap
        if not blocks or far or abs(line[1] - blocks[-1][0][1]) > 2 or abs(line[5] - lines[k - 1][5]) / max(lines[k - 1][5], 1) > 0.15:
            blocks.append([])
        blocks[-1].append(line)
    return blocks


def plain_fit(block):
    """(size, dropped lines) of a block with letters half as wide as they are high."""
    text, x = "\n".join(line[0] for line in block), min(line[1] for line in block)
    width = max(max(line[1] + line[3] for line in block) - x, 1.0)
    size = max(line[5] for line in block)
    height = max(max(line[2] for line in block) - min(line[2] - line[4] for line in block), size)
    size = min(max(size, 6.0), 16.0)
    for _ in range(24):
        n = 0
        for paragraph in text.split("\n"):
            line = ""
            for w in paragraph.split():
                if (len(line) + 1 + len(w) if line else len(w)) * size * 0.5 <= width:
                    line = f"{line} {w}" if line else w
                    continue
                n += bool(line)
                line = w
                while len(line) > 1 and len(line) * size * 0.5 > width:
                    k = max(1, next((k for k in range(len(line) - 1, 1, -1) if k * size * 0.5 <= width), 1))
                    n, line = n + 1, line[k:]
            n += 1
        if n * size * 1.3 <= height or size <= 6:
            break
        size = max(6.0, size * 0.95)
    return size, max(0, n - max(1, int(height // (size * 1.3))))


def test_layout(spark):
    pages = defaultdict(list)
    for i in documents.page_items(documents.load(spark, DATA, "pages")).collect():
        pages[i.doc_id, i.page].append(i.asDict())
    lines = {k: plain_lines(v) for k, v in pages.items()}
    got = defaultdict(list)
    for r in sorted(rows_of(spark, "page_lines"), key=lambda r: r.line_idx):
        got[r.doc_id, r.page].append(r.text)
    assert got == {k: [x[0] for x in v] for k, v in lines.items() if v}
    gaps = {k: round(g, 9) for k, v in lines.items() if (g := plain_gap(v)) is not None}
    assert {(r.doc_id, r.page): round(r.line_gap, 9) for r in rows_of(spark, "modal_gap")} == gaps
    blocks = {k: plain_blocks(v) for k, v in lines.items() if v}
    assert {(r.doc_id, r.page): (r.blocks, r.lines) for r in rows_of(spark, "page_blocks")} == {k: (len(v), sum(map(len, v))) for k, v in blocks.items()}
    bands = Counter()
    for (doc, _), own in pages.items():
        ys = sorted((i["y"] for i in own), reverse=True)
        bands[doc] += 1 + sum(abs(a - b) > 4 for a, b in zip(ys, ys[1:], strict=False))
    assert {r.doc_id: (r.bands, r["items"]) for r in rows_of(spark, "line_bands")} == {d: (n, sum(len(v) for k, v in pages.items() if k[0] == d)) for d, n in bands.items()}
    fits = defaultdict(list)
    for (doc, _), own in blocks.items():
        fits[doc] += map(plain_fit, own)
    got = {r.doc_id: (r.blocks, round(r.min_size, 6), r.dropped) for r in rows_of(spark, "fitted_blocks")}
    assert got == {d: (len(f), round(min(s for s, _ in f), 6), sum(n for _, n in f)) for d, f in fits.items()}


def test_language_report(spark, docs):
    groups = defaultdict(list)
    for d in docs:
        t, rule = d["text"], rules.BY_LANG[d["lang"]]
        plain = re.sub("[‎‏]", "", t)
        script = len(re.findall(f"[{rule[6]}]", plain)) / max(1, len(plain))
        lines = t.split("\n")
        groups[d["lang"], d["source"]].append((len(plain_chunks(t, 2_500, "job")), len(words(t)), script, len(lines), len(set(lines)), max(0, 100 - 20 * len(plain_language(d["lang"], t, t)))))
    got = {(r.lang, r.source): r for r in rows_of(spark, "language_qa_report")}
    assert got.keys() == groups.keys()
    for k, own in groups.items():
        chunks, n, script, lines, different, scores = zip(*own, strict=True)
        r = got[k]
        assert (r.documents, r.chunks, r.words) == (len(own), sum(chunks), sum(n))
        assert (r.passed, r.warned, r.failed) == (sum(s == 100 for s in scores), sum(60 <= s < 100 for s in scores), sum(s < 60 for s in scores))
        assert abs(r.script_ratio - sum(script) / len(own)) < 2e-6 and abs(r.duplicate_line_rate - (1 - sum(different) / sum(lines))) < 2e-6 and abs(r.mean_score - sum(scores) / len(own)) < 2e-4


def test_page_shares(spark, docs):
    wanted = {}
    for d in docs:
        own = [len(words(p)) for p in d["text"].split("\n")]
        at = 0
        for k, share in enumerate((30, 50, 20)):
            target, start, n = math.floor(share / 100 * sum(own)), at, 0
            while at < len(own) and (k == 2 or n + own[at] <= target):
                n, at = n + own[at], at + 1
                if k < 2 and n >= target:
                    break
            wanted[d["doc_id"], k] = at - start
    assert {(r.doc_id, r.page): r.paragraphs for r in rows_of(spark, "page_shares")} == wanted


def test_localized_texts(spark, docs):
    chunks = sum(len(plain_chunks(d["text"], 200, "job")) for d in docs)
    got = {(r.lang, r.status): (r.chunks, r.score) for r in rows_of(spark, "localized_texts")}
    assert {k: n for k, (n, _) in got.items()} == {("fr", "done"): chunks, ("ru", "done"): chunks}
    # Latin letters fail a Russian text's script and language checks, and never a French one's.
    assert got["ru", "done"][1] < got["fr", "done"][1] <= 100 * chunks
