"""Each operator against a plain version of itself, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, centroids, hyperminhash, license_scan, packing, phrases, pii, simhash, suffix_dedup, telephony, token_files, topk, toxicity
from tessella.llm._shared import shared_dir
from tessella.llm.components import components
from tessella.llm.repeats_kernel import anchors, window_hashes

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, i long, t string, key string, spans string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 7))) for _ in range(60)]
PASSAGE = " ".join(RNG.choice(WORDS) for _ in range(45))


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def near(text):
    words = text.split()
    for _ in range(2):
        words[RNG.randrange(len(words))] = "edited"
    return " ".join(words)


BASE = sentence(90)
TEXTS = [
    None, "", " ", "\n\t\r\x0b", "one", "ein zwei drei vier", BASE, BASE, *(near(BASE) for _ in range(6)), sentence(40) + " " + PASSAGE + " " + sentence(30), PASSAGE, "x" + PASSAGE + "y", "a" * 700, "ab" * 300, "é" * 120,
    "a  b   c \n\n  d\t\x85　x 's'll don't ½²", "mail me: ann.b@mail.example.com or +1 (626) 555-5759, 4111 1111 1111 1111 at 10.0.0.255, 300.1.1.1 password=ab12cd34ef56", "Licensed under CC BY-NC 4.0.\nmore\nReleased under the MIT License.",
    *(sentence(RNG.randint(1, 80)) for _ in range(40)), "z" * 3000 + " " + sentence(20) * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k * 10, t, k, "t", "k", "s") for k, t in enumerate(TEXTS)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(text):
    return text if text is not None else ""


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_licenses(spark, docs, none):
    got = license_scan.scan(docs)
    assert {(r.doc_id, r.segment, r.license, r.dice) for r in got.collect()} == {(220, 0, "cc-by-nc-4.0-line", 1.0), (220, 2, "mit-line", 1.0)}
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    assert license_scan.scan(none).count() == 0
    header = license_scan.TEMPLATES["apache-2.0-header"]
    near_copy = " ".join(w for k, w in enumerate(header.split()) if k % 17 != 5)
    rows = spark.createDataFrame([(1, near_copy), (2, "all rights"), (3, "Licensed to nobody at all under this sky.")], "doc_id long, text string")
    found = license_scan.scan(rows).collect()
    assert [(r.doc_id, r.license) for r in found] == [(1, "apache-2.0-header")] and 0.8 <= found[0].dice < 1


def test_licenses_of_several_paragraphs(spark):
    """Published layouts, against every run of blocks by brute force."""
    gpl = license_scan.TEMPLATES["gpl-3.0-header"].replace("version. This", "version.\n\nThis")
    bsd = license_scan.TEMPLATES["bsd-2-text"].replace(" 1. Red", "\n\n1. Red").replace(" 2. Red", "\n \t\n2. Red")
    mit = license_scan.TEMPLATES["mit-text"].replace("conditions: The", "conditions:\n\nThe")
    one_by_one = "\n\n".join(license_scan.normalised(license_scan.TEMPLATES["isc-text"]))
    first, second = license_scan.TEMPLATES["isc-text"].split(" for any ", 1)
    repeated = first + "\n\nfor any " + "\n\nfor any ".join([second] * 14)
    turns = "\n\n".join(["Released under the MIT License.", "The MIT License."] * 5)
    texts = [gpl, bsd, mit, f"title\n\n***\n\n{gpl}\n\nan end of it", f"{bsd}\n\n{mit}", one_by_one, "\n\n", "a\n\nb", None, repeated, turns, "\n\n".join(["MIT License released"] * 9 + ["under the MIT License"] * 3), f"{repeated}\n\n{gpl}", "software\n\n" * 3_000, bsd]
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, segment string, blocks int")
    found = collections.defaultdict(dict)
    for r in license_scan.scan(rows).where("blocks > 1").collect():
        found[r.doc_id][r.segment, r.blocks, r.most_blocks] = (r.license, r.dice)
    sets = {name: {(a, b) for a, b in itertools.pairwise(license_scan.normalised(t))} for name, t in license_scan.TEMPLATES.items()}
    for k, text in enumerate(texts[:13]):
        own, wanted = [w for b in re.split(r"\n[ \t]*\n", plain(text)) if (w := license_scan.normalised(b))], collections.defaultdict(list)
        for i, j in itertools.combinations(range(len(own)), 2):
            pairs = frozenset(itertools.pairwise(itertools.chain(*own[i : j + 1])))
            dice, name = min((-2 * len(pairs & s) / (len(pairs) + len(s)), name) for name, s in sets.items())
            if -dice >= license_scan.THRESHOLD and not (0 < i < len(own) - 1 and own[i - 1] == own[i] == own[i + 1]):
                wanted[i, pairs, name, round(-dice, 6)].append(j - i + 1)
        assert found[k] == {(i, min(n), max(n)): (name, dice) for (i, _, name, dice), n in wanted.items()}
    assert found[0] == {(0, 2, 2): ("gpl-3.0-header", 1.0)} and found[1][0, 3, 3] == ("bsd-2-text", 1.0) and found[2] == {(0, 2, 2): ("mit-text", 1.0)}
    assert found[3][1, 2, 2] == ("gpl-3.0-header", 1.0) and found[5] and found[9][0, 3, 15][0] == "isc-text" and found[10] and not found[13] and found[14] == found[1]


def test_license_anchors_cover_every_match():
    for text in license_scan.TEMPLATES.values():
        words = license_scan.normalised(text)
        least = license_scan.THRESHOLD / (2 - license_scan.THRESHOLD)
        kept, pairs = license_scan.anchors(words, least), {(a, b) for a, b in zip(words, words[1:], strict=False)}
        assert sum(not kept.intersection(p) for p in pairs) < least * len(pairs) + 1e-9


@pytest.mark.parametrize(("chunk", "overlap"), [(60_000, 1_000), (300, 40)])
def test_bpe(docs, none, chunk, overlap):
    code = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = by_id(bpe.bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap))
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        ids = code.encode(plain(t))
        assert tuple(got[k * 10]) == (k * 10, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain(t).encode()).hexdigest())
    assert bpe.bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_of_mixed_white_space(spark):
    code = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert code.encode("x \u00a0 \u00a0 y") == code.ids("x \u00a0 \u00a0 y") == [87, 11504, 331]
    spaces = [" ", "\u00a0", "\u3000", "\n", "\t", "\x1c", "\x85"]
    runs = ["".join(r) for n in range(1, 5) for r in itertools.product(spaces, repeat=n)]
    texts = [f"{a}{r}{b}" for r in runs for a, b in (("x", "y"), ("", "'s"), ("1 a", "!"), ("x", ""))]
    assert [t for t in texts if code.ids(t) != code.encode(t)] == []
    mixed = [(k, f"x{r}y the" * 30) for k, r in enumerate(["\u00a0 ", " \u00a0 \u00a0 ", "\u3000 \u3000", " \n \u3000 "])]
    for chunk, overlap in ((60_000, 1_000), (50, 20)):
        got = by_id(bpe.bpe_round_trip(spark.createDataFrame(mixed, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap))
        for k, t in mixed:
            assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, code.encode(t))).encode()).hexdigest()


def plain_repeats(texts, width=100):
    seen, out = set(), {}
    for i, t in texts:
        b = plain(t).encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = True
            seen.add(b[s : s + width])
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("many", [0, 2_000])
def test_suffix_dedup(docs, none, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 3_000)
    monkeypatch.setattr(suffix_dedup, "DEALT", 9_000)
    wanted = plain_repeats([(k * 10, t) for k, t in enumerate(TEXTS)])
    assert {i: tuple(r) for i, r in by_id(suffix_dedup.dedup_report(docs)).items()} == wanted
    assert suffix_dedup.dedup_report(none).count() == 0
    kept = by_id(suffix_dedup.drop_repeats(docs))
    assert kept[70].text == "" and kept[60].text == BASE and kept[0].text is None and kept[0].spans == "s"


@pytest.mark.parametrize("many", [0, 2_000])
def test_suffix_dedup_of_repeated_rows(spark, many, monkeypatch):
    """Rows of one id with other texts are documents of their own; rows that repeat both are one."""
    import xxhash

    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(12)
    shared = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4)]
    texts = [sentence(12) + shared[k % 4] + sentence(9) + shared[(k + 1) % 3] for k in range(12)] + ["q" * 300, None, "short"]
    rows = [(k % 5 if k % 3 else None, t) for k, t in enumerate(texts)]
    rows += rows[:7] + rows[:2] + [(1, texts[0]), (None, texts[0])]

    def tie(t):
        h = xxhash.xxh64_intdigest(plain(t).encode(), seed=42)
        return h - (1 << 64) if h >> 63 else h

    order = sorted({(-(1 << 63) if i is None else i, tie(t), plain(t)) for i, t in rows})
    wanted = plain_repeats([((i, h), t) for i, h, t in order])
    rows = [*rows] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(tuple(r) for r in suffix_dedup.dedup_report(docs).collect())
    assert got == collections.Counter((i, *wanted[-(1 << 63) if i is None else i, tie(t)][1:]) for i, t in rows)
    # The whole table repeats: nothing is lost but what repeats inside it.
    left = suffix_dedup.drop_repeats(docs)
    assert left.count() == len(rows) and {len(r.text.encode()) for r in left.where("text is not null").collect()} == {w[1] - w[2] for w in wanted.values()}
    twice = spark.createDataFrame([(7, BASE), (7, BASE)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_report(twice).collect()] == [0, 0]


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_anchors_are_leftmost_least(letters):
    data = np.random.default_rng(letters).integers(0, letters, 700).astype(np.uint8)
    digit, window = window_hashes(data, (24, 100))
    place, first, last = anchors(digit, 100)
    assert np.repeat(place, last - first + 1).tolist() == [s + int(np.argmin(digit[s : s + 77])) for s in range(601)]
    assert len(set(window.tolist())) == len({data[s : s + 100].tobytes() for s in range(601)})


BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def plain_pack(sizes, capacities):
    """The same rules in loops over all bins, all lengths and all sizes to come."""
    bins = []  # [length, filled, when it last changed]
    placed, lengths = [], sorted(capacities)
    for k, size in enumerate(sizes):
        open_ = [b for b in bins if b[0] - b[1] >= size]
        if open_:
            own = min(open_, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            best = None
            for c in lengths:
                if c >= size:
                    room, held = c - size, size
                    for later in sorted(sizes[k + 1 :], reverse=True):
                        if later <= room:
                            room, held = room - later, held + later
                    end = min(x for x in lengths if x >= held)
                    price = end * (1 + end / packing.ATTENTION) / held
                    if best is None or price < best[0]:
                        best = (price, c)
            own = [best[1], 0, 0]
            bins.append(own)
        placed.append((next(n for n, b in enumerate(bins) if b is own), own[1]))
        own[1], own[2] = own[1] + size, k + 1
    return placed, [min(c for c in lengths if c >= b[1]) for b in bins], [b[0] for b in bins]


def least_cost(sizes, capacities):
    """Over all ways to put the sizes into bins."""
    best = [float("inf")]

    def put(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for n in range(len(bins)):
            if bins[n] + sizes[k] <= max(capacities):
                put(k + 1, [*bins[:n], bins[n] + sizes[k], *bins[n + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best[0]


def test_packing_equals_a_plain_version():
    rng, longer, downsized, ratios = random.Random(7), 0, 0, []
    for n in range(400):
        sizes = sorted((rng.choice([rng.randint(1, 32), rng.randint(1, 12)]) for _ in range(rng.randint(1, 40 if n % 2 else 6))), reverse=True)
        made, final, offset = packing.pack(np.array(sizes), (8, 16, 32))
        placed, wanted, opened = plain_pack(sizes, (8, 16, 32))
        assert list(zip(made.tolist(), offset.tolist(), strict=True)) == placed and final.tolist() == [wanted[b] for b, _ in placed]
        first = {}
        for (b, _), size in zip(placed, sizes, strict=True):
            first.setdefault(b, size)
        longer += sum(opened[b] > min(c for c in (8, 16, 32) if c >= size) for b, size in first.items())
        downsized += sum(o > w for o, w in zip(opened, wanted, strict=True))
        if len(sizes) <= 6:
            ratios.append(sum(map(packing.cost, wanted)) / least_cost(sizes, (8, 16, 32)))
    print(f"{longer} longer, {downsized} downsized, cost {sum(ratios) / len(ratios):.3f} times the least, {max(ratios):.2f} at most")
    assert longer > 50 and downsized > 0 and sum(ratios) / len(ratios) < 1.1 and max(ratios) < 2


def test_words_of_pieces_equal_the_encoder():
    code, (first, after) = bpe.codec(*BPE), packing._raw(*BPE)
    rng, parts = random.Random(21), ["Ab", "é", "½", "²", "1", ".", ",", "!?", "...", "'s", "’", "_", "ß", "中", "\u0301", ":"]
    for _ in range(20_000):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        for kept, before in ((first, ""), (after, " ")):
            assert np.frombuffer(kept[word], "<u2").tolist() == code.encode(before + word), word


def test_different_words_of_pieces_are_encoded_in_one_call(monkeypatch):
    """what costs is the number of different words, and of calls one for each group of texts."""
    code, rng, calls = bpe.codec(*BPE), random.Random(22), []
    inside, between = ["Ab", "é", "½", "1", ".", "!?", "'s", "’", "中", "\u0301", "\x1c", "\x00"], [" ", " ", " ", "\n", "\t", "\x85", "\xa0"]
    texts = ["", *("".join(rng.choice(inside) + rng.choice(between + [""]) for _ in range(rng.randint(0, 12))) + "z" for _ in range(5_000))]
    encode = code.encode_to_array
    monkeypatch.setattr(code, "encode_to_array", lambda *a, **b: calls.append(1) or encode(*a, **b))
    assert [ids.tolist() for ids in packing.together(pa.array(texts, pa.string()), code)] == [code.encode(t) for t in texts] and len(calls) == 1
    assert packing.together(pa.array([], pa.string()), code) == []


def test_sequences_of_a_shard_without_tokens():
    rows = pa.table({"doc_id": pa.array([None, 1 << 60], pa.int64()), "piece": pa.array([0, 0], pa.int32()), "first_token": pa.array([0, 0], pa.int64()), "n_tokens": pa.array([0, 0], pa.int32()), "ids": pa.array([b"", b""]), "number": [0, 1]})
    made = packing.sequences(rows, 3, (4, 8), np.dtype("<u2"))
    assert made["doc_ids"].to_pylist() == [[None], [1 << 60]] and made["ids"].to_pylist() == [[], []] and made["bin_id"].null_count == 2


def test_packing(spark, docs, none):
    code, lengths = bpe.codec(*BPE), (16, 32, 64)
    made = packing.pack_documents(docs, *BPE, lengths, shard=20)
    rows, ids = made.collect(), {k * 10: code.encode(plain(t)) for k, t in enumerate(TEXTS)}
    back = collections.defaultdict(dict)
    for r in rows:
        assert len(r.ids) == r.n_tokens == sum(r.lengths)
        at = 0
        for i, piece, first, n in zip(r.doc_ids, r.pieces, r.first_tokens, r.lengths, strict=True):
            assert first == piece * 64 and piece not in back[i]
            back[i][piece] = r.ids[at : at + n]
            at += n
        assert (r.bin_id is None) == (r.n_tokens == 0) and r.bin_capacity == (min(c for c in lengths if c >= at) if at else None)
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in back.items()} == ids
    assert sum(map(len, ids.values())) / sum(r.bin_capacity or 0 for r in rows) > 0.85
    # Shards are bounded in pieces, also where one text makes most of them.
    long = spark.createDataFrame([(1, "a b c d e f " * 4_000), (1, "a"), (None, None)], "doc_id long, text string")
    own = packing.pack_documents(long, *BPE, (4, 8), shard=100)
    sizes = [r.n for r in own.groupBy(F.shiftright("bin_id", 32)).agg(F.sum(F.size("pieces")).alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 200
    spots = packing.placements(own)
    assert spots.where("n_tokens > 0").groupBy("bin_id", "bin_offset").count().where("count > 1").count() == 0
    assert spots.where("bin_id is null").collect()[0][:4] == (None, 0, 0, 0)
    assert packing.pack_documents(none, *BPE).count() == 0
    # Repeated rows are packed each.
    assert sum(r.n_tokens for r in packing.pack_documents(docs.union(docs), *BPE).collect()) == 2 * sum(map(len, ids.values()))
    # Best fit: 5 goes where exactly 5 are left, not where 7 are.
    made, final, offset = packing.pack(np.array([11, 9, 5, 4]), (16,))
    assert made.tolist() == [0, 1, 0, 1] and final.tolist() == [16] * 4 and offset.tolist() == [0, 0, 11, 9]
    # A bin is as short as what it holds allows.
    assert packing.pack(np.array([10]), (16, 64))[1].tolist() == [16]


def test_packing_opens_larger_bins_and_downsizes(monkeypatch):
    # Three pieces leave most of a short bin empty each, and fill one of twice the length.
    made, final, offset = packing.pack(np.array([300, 300, 300]), (512, 1024))
    assert made.tolist() == [0, 0, 0] and final.tolist() == [1024] * 3 and offset.tolist() == [0, 300, 600]
    # 15 is opened for 13 and 3 to come, which then fit other bins better.
    lengths, choose = [], packing.opened
    monkeypatch.setattr(packing, "opened", lambda *a: lengths.append(choose(*a)) or lengths[-1])
    made, final, _ = packing.pack(np.array([29, 18, 15, 13, 3]), (8, 16, 32))
    assert lengths == [32, 32, 32] and made.tolist() == [0, 1, 2, 1, 0] and final.tolist() == [32, 32, 16, 32, 32]


def plain_components(texts):
    sets = {}
    for i, t in texts:
        w = plain(t).encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (i, len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_near_duplicates(docs, none):
    texts = [(k * 10, t) for k, t in enumerate(TEXTS)]
    assert {i: tuple(r) for i, r in by_id(hyperminhash.near_duplicates(docs)).items()} == plain_components(texts)
    assert hyperminhash.near_duplicates(none).count() == 0
    assert hyperminhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    texts = [(k, near(BASE)) for k in range(60)] + [(100 + k, sentence(30)) for k in range(20)]
    monkeypatch.setattr(hyperminhash, "compare_groups", lambda *a: __import__("tessella.llm.components", fromlist=["x"]).compare_groups(*a, block=7))
    got = by_id(hyperminhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {i: tuple(r) for i, r in got.items()} == plain_components(texts)


def test_registers_and_components(spark):
    x = np.array([1, 2, 3, 1 << 63, (1 << 64) - 1, 5 << 40], dtype=np.uint64)
    wanted = [((64 - int(v).bit_length()) << 10) | (((int(v) << (65 - int(v).bit_length())) & ((1 << 64) - 1)) >> 54) for v in x]
    # The largest value may round up to 2^64 as a float; its leading zeros stay 0.
    assert hyperminhash.registers(x).tolist() == wanted
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "id long, root long")
    got = {r.id: r.component for r in components(chain).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def plain_segments(weights):
    def inside(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += weights[j]
                if best is None or total > best[0] + 1e-12 or (abs(total - best[0]) < 1e-12 and j - i < best[2] - best[1]):
                    best = (total, i, j)
        return [] if best is None or best[0] <= 0 else [*inside(a, best[1]), (best[1], best[2]), *inside(best[2] + 1, b)]

    return inside(0, len(weights))


def test_segments_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(400):
        w = [rng.choice([-1, -1, -1, rng.random() * 3]) for _ in range(rng.randint(1, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments([(k, x) for k, x in enumerate(w) if x > 0], -1)] == plain_segments(w)


def test_toxicity(spark, none):
    rows, labels = [], []
    for k in range(900):
        bad = k % 6 == 0
        text = sentence(60)
        rows.append((k, text.replace(" ", f" vile{'abcdefg'[k % 7]}x rotten ", 1) if bad else text))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "!!! 12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_of(model, F.col("text")).alias("s")).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all((got[k] >= toxicity.THRESHOLD) == (k % 6 == 0) for k in held)
    assert got[1000] == got[1001] == got[1002] < toxicity.THRESHOLD
    assert {r.doc_id for r in docs.where(toxicity.held_out()).where("doc_id < 900").collect()} == set(held)
    found = docs.where("doc_id = 6").select(F.explode(toxicity.passages_of(model, F.col("text"))).alias("p")).first().p
    assert found.first <= 2 and found.chance < 0.5
    assert toxicity.reject_toxic(docs, model).where("doc_id % 6 = 0 and doc_id < 900").count() == 0
    assert toxicity.fit(none, table).score(None, "") == 0
    assert toxicity.fit(docs, table.where("toxic = 0")).score(None, "vile rotten") == 0
    assert toxicity.reject_toxic(none, model).count() == 0 and toxicity.reject_toxic(none, model).columns == none.columns
    # Other columns of the same names, several labels a document and repeated rows change nothing.
    wide = docs.withColumn("toxic", F.lit("x")).withColumn("k", F.lit(1)).withColumn("fold", F.lit(2)).withColumn("token", F.lit(""))
    more = table.unionByName(table.where("toxic = 1").withColumn("toxic", F.lit(0))).withColumn("text", F.lit("other"))
    again = toxicity.fit(wide.union(wide), more)
    assert again.weights == model.weights and again.curve == pytest.approx(model.curve)
    long = spark.createDataFrame([(1, sentence(9) * 50_000), (2, sentence(9) * 50_000 + " vileax rotten vilebx rotten")], "doc_id long, text string")
    kept = [r.s for r in long.orderBy("doc_id").select(toxicity.score_of(model, F.col("text")).alias("s")).collect()]
    assert kept[0] < kept[1]


def test_extreme_value_law_of_clean_texts():
    """The law fits the best segments of texts it has not seen: few more stand out than it says."""
    rng = np.random.default_rng(6)

    def best(n):
        weights = np.where(rng.random(n) < 0.01, rng.choice([1.6, 2.4, 3.2], n), 0)
        return max((s for _, _, s in toxicity.segments([(k, w) for k, w in enumerate(weights.tolist()) if w])), default=0.0)

    n = rng.integers(20, 3_000, 3_000)
    s = np.array([best(k) for k in n])
    scale, log_k = toxicity.extreme_value_law(s[:2_000], n[:2_000].astype(float))
    chance = -np.expm1(-np.exp(log_k + np.log(n[2_000:]) - scale * s[2_000:]))
    assert all(a / 3 < (chance < a).mean() < 1.6 * a for a in (0.2, 0.1, 0.05))


def plain_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            size = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - size if n & 8 else value + size))
            index = max(0, min(88, index + int(telephony.MOVES[n])))
            out.append(value)
    return out


def test_telephony(spark, docs, none):
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 576)).astype(np.uint8)
    assert telephony.ima_decode(blocks).tolist() == [plain_ima(b.tobytes()) for b in blocks]
    assert telephony.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and telephony.ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    for kind in ("mulaw", "alaw", "ima"):
        media = telephony.in_shared_folder(telephony.store_media(docs, kind), "media")
        stored = telephony.in_shared_folder(telephony.stored_pcm(media), "pcm")
        files, got = {r.doc_id: bytes(r.media) for r in media.collect()}, by_id(telephony.media_report(stored))
        pcm = {r.doc_id: bytes(r.pcm) for r in stored.collect()}
        for k, t in enumerate(TEXTS):
            raw = plain(t).encode()
            padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            r = got[k * 10]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
            assert r.media_bytes == len(files[k * 10]) > len(padded) and r.media_sha256 == hashlib.sha256(files[k * 10]).hexdigest()
            assert (r.feature == got[60].feature) == (t == BASE)
            if kind == "ima":
                plain_pcm = [x for at in range(0, len(padded), 576) for x in plain_ima(padded[at : at + 576])]
            else:
                plain_pcm = [int((telephony.MULAW if kind == "mulaw" else telephony.ALAW)[x]) for x in padded]
            doubled = [x for a, b in zip(plain_pcm, [*plain_pcm[1:], plain_pcm[-1]], strict=True) for x in (a, a + b >> 1)]
            assert np.frombuffer(pcm[k * 10], "<i2").tolist() == doubled
            assert r.feature.split(";")[0] == f"pcm:{len(doubled)}:{zlib.crc32(pcm[k * 10]):08x}:{sum(map(abs, plain_pcm)) // len(plain_pcm)}"
    again = telephony.media_report(telephony.stored_pcm(telephony.store_media(docs.union(docs)))).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("d"))
    assert {(r.n, r.d) for r in again.collect()} == {(2, 1)}
    odd = spark.createDataFrame([(1, 0, b"nothing"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.feature for r in telephony.media_report(telephony.stored_pcm(odd)).collect()] == [None, None]
    assert telephony.media_report(telephony.stored_pcm(telephony.store_media(none))).count() == 0


def test_media_of_like_texts_are_stored_together(spark):
    """pages of one language and alphabet compress better; each text is still stored."""
    texts = [(k, ["plain words", "größere Wörter", "слова"][k % 3] + f" {k // 6}") for k in range(18)] + [(None, None), (18, "")]
    got = [bytes(telephony.read_wav(bytes(r.media))[1]).rstrip(b"\xff").decode() for r in telephony.store_media(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()]
    kinds = [0 if t.isascii() else 1 if "ö" in t else 2 for t in got]
    assert sorted(got) == sorted(t or "" for _, t in texts) and kinds == sorted(kinds) and got[2:8] == sorted(got[2:8])


def test_media_sort_compares_columns(spark):
    """a sort that holds an expression counts both texts' characters again at every comparison."""
    plan = telephony.store_media(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    (sort,) = (line for line in plan.splitlines() if "Sort [" in line)
    assert "alphabet" in sort and "length(" not in sort


def test_token_files(docs, none):
    path = P.path("word_bpe_49k.json")
    coder = token_files.word_encoder(path).tokenizer
    got, start = by_id(token_files.token_file_report(docs, path)), 0
    for k, t in enumerate(TEXTS):
        ids = [*coder.encode(plain(t), add_special_tokens=False).ids, 1]
        assert tuple(got[k * 10]) == (k * 10, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_file_report(none, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    coder, rng = token_files.word_encoder(P.path("word_bpe_49k.json")), random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["Ab", "é", "É", "İ", "Σ", "ΑΣ", "'s", "’", "..", "1", "½", " ", "\n", "\x01", "\x1c", " ", "é", "ß", "straße,", "!!", "<|endoftext|>"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_learned_without_case_and_punctuation():
    """what costs is the number of different words, so forms of one word are one."""
    coder, rng = token_files.WordEncoder(P.path("word_bpe_49k.json")), random.Random(12)
    stems = ["straße", "under", "colour", "ñandú"]
    texts = ["\n".join(rng.choice([w, w.capitalize(), w.upper() if w.isascii() else w]) + rng.choice(["", ".", ",", "!?", '."']) for w in rng.choices(stems, k=20)) for _ in range(200)]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [w for w in coder.known if w[-1:] in '.,?"' and w[:1].isalpha()] and {"under", "colour"} < set(coder.known) and "Under" not in coder.known


def test_case_and_marks_of_texts_equal_the_tokenizer():
    coder, rng = token_files.word_encoder(P.path("word_bpe_49k.json")), random.Random(11)
    parts = ["Ab", "J\u030c", "É", "İ.", "ΑΣ", "'S", "x.'s", "..", "<|ENDofText|>", "|>", "\u212a", ".a", "A.", "=", "\u0338", "ᄒ", "ᅡ", "½", " ", "\t", "\x85", "\x01"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2_000)]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(10)
    own = Tokenizer.from_file(path)
    assert own.encode("end <|endoftext|> of", add_special_tokens=False).ids == [806, 49407, 539]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "Ab", "É", "ΑΣ", "'s", "..", "1", " ", "\n", "\x01", "\u00a0", "e\u0301"]
    texts = ["end <|endoftext|> of", "end<|endoftext|>of", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    got, start = by_id(token_files.token_file_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)), 0
    for k, t in enumerate(texts):
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        assert tuple(got[k]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 16)) * rng.gamma(2, size=(400, 1))
    v[7] = v[8]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1003, [1.0] * 3), (1050, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = np.floor(256 * np.float32(v).astype(float)).astype(np.int64)
    for options in ({}, {"block": 32, "queries": 3}):
        got = collections.defaultdict(list)
        for r in topk.top_k(table, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert sorted(got) == list(range(0, 400, 50))
        for q, found in got.items():
            s = whole @ whole[q]
            best = sorted((-int(s[k]), k) for k in range(400) if k != q)[:5]
            assert found == [(n + 1, k, -x) for n, (x, k) in enumerate(best)]
    assert topk.top_k(table.where("vec_id in (50, 51)")).count() == 1
    # Rows that repeat an id count as the query's own row for it, and as candidates each; other columns may have any name.
    twice = table.where("vec_id < 60").withColumn("g", F.lit("x")).withColumn("top", F.lit(1)).withColumn("r", F.lit(2))
    got = collections.defaultdict(list)
    for r in topk.top_k(twice.union(twice.where("vec_id in (8, 9)"))).collect():
        got[r.query_id].append((-r.score, r.vec_id))
    for q in (0, 50):
        s = whole[:60] @ whole[q]
        assert sorted(got[q]) == sorted((-int(s[k]), k) for k in [*range(60), 8, 9] if k != q)[:5]
    assert topk.top_k(table.where("vec_id > 999 and vec_id <> 1003")).count() == 0


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a", "@", ".", "1", "2", "-", " ", "+", "(", "55", "4111 1111 1111 1111", "a@b.c", "%", "1.2.3.4", "é", "256"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data(docs, none):
    model = pii.fit(docs)
    got = {r.doc_id: r for r in docs.select("doc_id", pii.spans_of(model, F.col("text")).alias("s")).select("doc_id", "s.*").collect()}
    for k, t in enumerate(TEXTS):
        base = plain_spans(plain(t))
        joined = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in base)
        r = got[k * 10]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(kind == n for _, kind, _ in base) for n in range(4))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert (got[210].n_email, got[210].n_ip, got[210].n_card, got[210].n_phone) == (1, 1, 1, 1)
    masked = {r.doc_id: r.m for r in docs.select("doc_id", pii.redacted(model, F.col("text")).alias("m")).collect()}
    assert masked[0] is None and "[EMAIL]" in masked[210] and "@" not in masked[210] and masked[60] == BASE
    assert pii.fit(none).personal() == bytes(1 << pii.FEATURES)


def test_long_parts_of_an_address():
    zeros = "0" * 6_000
    assert pii.base_spans(f"{zeros}1.2.3.4") == [(0, 1, 6_007)] and pii.base_spans("9" * 4_500 + ".2.3.4") == []
    assert pii.base_spans("1.2.3." + "0" * 300 + "256") == []


def test_personal_data_in_long_texts_takes_linear_time():
    for text in ("z" * 3_000_000, "A-" * 1_000_000, "Ab " * 1_000_000, "=" * 2_000_000, "1." * 300_000, "Ab Ab@" * 300_000):
        began = time.perf_counter()
        pii.candidates(text, pii.base_spans(text))
        assert time.perf_counter() - began < 20


def test_expectation_maximisation_beats_the_majority():
    """Five labelers; one is wrong more often than right, two guess.  Known rows are few."""
    rng = np.random.default_rng(3)
    n = 6_000
    truth = rng.random(n) < 0.4
    hits = [(0.9, 0.1), (0.8, 0.15), (0.2, 0.75), (0.5, 0.5), (0.45, 0.5)]
    votes = np.column_stack([np.where(rng.random(n) < 0.2, 0, np.where(rng.random(n) < np.where(truth, hit, false), 1, -1)) for hit, false in hits])
    known = truth & (rng.random(n) < 0.03)
    table, p = pii.reliabilities(votes, np.ones(n), known)
    majority = votes.sum(axis=1) > 0
    assert ((p > 0.5) == truth)[~known].mean() > 0.87 > 0.8 > (majority == truth)[~known].mean()
    # What is learned is near the truth, and far from what the first guess would say of the bad labeler.
    start = pii.first_guess(votes)
    shares = [float(w[votes[:, 2] > 0].sum() / w[votes[:, 2] != 0].sum()) for w in (start, p)]
    learned = [table[j, 1, 2] / (table[j, 1, 0] + table[j, 1, 2]) for j in range(5)]
    assert shares[0] > 0.5 and abs(learned[2] - 0.2) < 0.06 and abs(learned[0] - 0.9) < 0.06


def planted(n, seed, listed=True):
    """Texts with spans that the method should add, and decoys: (text, [(start, end)]).  Unless ``listed``, no name is in a gazetteer."""
    rng, out = random.Random(seed), []

    def pick(words):
        if listed or "street" in words:
            return rng.choice(sorted(words)).capitalize()
        while (made := "".join(rng.choice("bdgklmnrstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))) in pii.GIVEN | pii.FAMILY:
            pass
        return made.capitalize()

    letters = "abcdef0123456789"
    for _ in range(n):
        text, spans = sentence(6), []
        for _ in range(4):
            kind = rng.randrange(9)
            if kind == 0:
                add = f"{pick(pii.GIVEN)} {pick(pii.FAMILY)}"
            elif kind == 1:
                add = f"{rng.randint(1, 999)} {sentence(1).capitalize()} {pick(['street', 'road', 'avenue', 'lane'])}"
            elif kind == 2:
                add = "password=" + "".join(rng.choice(letters) for _ in range(18))
            elif kind == 3:
                add = '"' + "".join(rng.choice(letters) for _ in range(40)) + '"'
                text += " token ="
            elif kind == 4:
                add = f"Mr. {sentence(1).capitalize()} {pick(pii.FAMILY)}"
            else:
                add = None
                text += " " + [f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"version {rng.randint(1, 9)}.", f"{sentence(1).capitalize()} {sentence(1).capitalize()}", f"in {rng.randint(1900, 2030)} ann{rng.randint(1, 99)}@mail.example.com"][kind - 5]
            if add:
                spans.append((len(text) + 1, len(text) + 1 + len(add)))
                text += " " + add
            text += " " + sentence(3)
        out.append((text, spans))
    return out


@pytest.mark.parametrize("listed", [True, False])
def test_added_spans_of_planted_data(spark, listed):
    cases = planted(1_500, 5, listed)
    model = pii.fit(spark.createDataFrame([(t,) for t, _ in cases], "text string").repartition(3))
    personal, right, added, found, wanted = model.personal(), 0, 0, 0, 0
    for text, spans in planted(500, 6, listed):
        base, every = pii.all_spans(text, personal)
        own = {(a, b) for a, k, b in every if (a, k, b) not in base}
        found += sum(any(x < b and y > a for x, y in own) for a, b in spans)
        right += sum(any(x < b and y > a for a, b in spans) for x, y in own)
        added += len(own)
        wanted += sum(not any(x < b and y > a for x, _, y in base) for a, b in spans)
    precision, recall = right / added, found / wanted
    print(f"added spans, names {'in' if listed else 'outside'} the lists: precision {precision:.3f}, recall {recall:.3f}")
    # Without a list a bare name looks like any two capitalised words; what has a title, a number or a key is still found.
    assert precision > 0.9 and recall > (0.9 if listed else 0.6)


def plain_phrases(rows, least, best):
    """Each language's best phrases, counted one by one."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), plain(text))):
            own = re.findall(r"[^ \t]+", piece)
            n[lang] += len(own)
            f.update((lang, tuple(own[i : i + k])) for k in range(1, 5) for i in range(len(own) - k + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        inside = any(100 * c >= 80 * a for (other, q), c in f.items() if other == lang and len(q) > len(p) and c >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if len(p) > 1 and a >= least and not inside:
            score, _, left, right = min((phrases.SCALE * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:best])}


@pytest.mark.parametrize("block", [1, 200, 1 << 21])
def test_phrases(spark, none, block):
    rng, few = random.Random(5), ["a", "b", "c", "Dé", "é"]
    texts = [(" ".join(rng.choice(few) + rng.choice(["", "", "", ".", " ,", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    texts += [(None, "en"), ("", None), (" \t ", "x"), ("!?..", "x"), ("a b\x1cc a\x85b a b", "en"), *[("same row again A B", "en")] * 9, ("x " * 5_000, "long")]
    rows = spark.createDataFrame([(t, lang, "p", 1, "q") for t, lang in texts], "text string, lang string, phrase string, n long, names string").repartition(3)
    for best in (2_000, 7):
        got = phrases.collocations(rows, least=4, best=best, block=block)
        assert {tuple(r) for r in got.collect()} == plain_phrases(texts, 4, best)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(none.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_phrases_keep_little_on_disk(spark, monkeypatch):
    rng, write, stored = random.Random(6), phrases.written, []
    texts = [(" ".join(f"w{rng.randint(1, 600)}" for _ in range(1_500)) + " of a kind", "en") for _ in range(40)]
    shared = Path(shared_dir(spark).removeprefix("file://"))
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def size():
        return sum(p.stat().st_size for p in shared.glob("phrase*/part-*"))

    def shuffled():
        return {p for d in folders for p in Path(d).rglob("shuffle_*")}

    def measured(*a, **b):
        out = write(*a, **b)
        stored.append(size() - before)
        return out

    monkeypatch.setattr(phrases, "written", measured)
    rows, before, old, setting = spark.createDataFrame(texts, "text string, lang string").repartition(4), size(), shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    every, _ = phrases.frequent_phrases(rows, 30, 4, 20_000, text_col="text", lang_col="lang")
    # The lists of words and little else is stored: those of pairs, nearly all of them rare, would be larger.  No shuffle files are left.
    assert max(stored) < 1.5 * stored[0]
    assert not shuffled() - old
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert {r.phrase: r.f for r in every.where("k > 1").collect()} == dict.fromkeys(["of a", "a kind", "of a kind"], 40)


def test_phrases_of_long_texts_are_cut_at_ends(monkeypatch):
    monkeypatch.setattr(phrases, "PART", 10)
    cut = list(phrases.parts("Abc def. ghi jkl mno pqr, stu! v"))
    assert b"".join(cut) == b"abc def\n ghi jkl mno pqr\n stu\n v" and len(cut) == 2 and all(c.startswith(b"\n") for c in cut[1:])
    places, words = np.array([0, 1, 2, 4, 5]), np.array([7, 8, 7, 7, 8])
    assert [x.tolist() for x in phrases.extended(places, words, words, 1)] == [[0, 1, 4], [7, 8, 7], [8, 7, 8]]


def plain_print(text):
    import xxhash

    own = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), plain(text))) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance and label[a] != label[b]:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
    return label


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs)
    prints = [plain_print(t) for t in TEXTS]
    label = plain_components(prints, 2)
    wanted = {(k * 10, f"{p:016x}", min(10 * j for j, other in enumerate(label) if other == label[k])) for k, p in enumerate(prints)}
    assert {tuple(r) for r in got.collect()} == wanted and got.columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "only here"), (None, "a b c"), (7, "A b  c"), (7, "a b c"), (7, "else"), (9, "long " * 100_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.fingerprint) for r in simhash.near_duplicates(odd).collect()) == sorted([(0, 0, f"{plain_print('only here'):016x}"), *[(0, 7, f"{plain_print('a b c'):016x}")], *[(7, 7, f"{plain_print('a b c'):016x}")] * 2, (7, 7, f"{plain_print('else'):016x}"), (9, 9, f"{plain_print('long long long'):016x}")])


@pytest.mark.parametrize(("distance", "count"), [(2, 2), (2, 3), (3, 2), (5, 4), (0, 2)])
def test_simhash_segments_lose_no_link(spark, distance, count):
    """Links by the index against all pairs, on fingerprints that are close to each other and share segments."""
    rng = random.Random(distance)
    prints = sorted({p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2 * distance))) for p in [rng.getrandbits(64) for _ in range(5)] for _ in range(24)} | {rng.getrandbits(32) << 32 * k | 5 << 32 * (1 - k) for k in (0, 1) for _ in range(20)} | {0})
    assert all(sum(r + 1 for *_, r in simhash.segments(d, c)) + 0 * d >= 1 for d, c in [(distance, count)])
    signed = [p - (p >> 63 << 64) for p in prints]
    index = simhash.index_rows(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), distance, count).cache()
    met = index.join(index.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").select("g", "n", "id", F.col("id").alias("print"), "asks")
    found = {r.id: r.component for r in components(simhash.compare_groups(met, ["print", "asks"], simhash.near(distance), block=16)).collect()}
    label = plain_components(prints, distance)
    assert [found.get(s, s) for s in signed] == [min(signed[j] for j, other in enumerate(label) if other == label[k]) for k in range(len(prints))]


def plain_clusters(rows, count=16, rounds=3):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    centroids = [v for _, v in start]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((gap(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == k]) else c for k, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = collections.Counter()
    for _, d, k in last:
        each[k] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i or -1, k, fits(d), fits(each[k]), fits(sum(each.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last), key=repr)


@pytest.mark.parametrize("case", ["spread", "ties", "few", "large"])
def test_centroids(spark, none, case):
    rng = np.random.default_rng(3)
    made = {"spread": rng.normal(size=(300, 64)), "ties": np.sign(rng.normal(size=(200, 64)).round()) * (np.arange(64) < 3), "few": rng.normal(size=(5, 64)), "large": rng.normal(size=(60, 64)) * 10.0 ** rng.integers(0, 8, size=(60, 1))}[case]
    rows = [(k, v.tolist()) for k, v in enumerate(made)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] * 64), (None, rows[0][1]), rows[1], (1, rows[2][1])]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, ids string").repartition(3)
    got = centroids.clusters(table, block=32)
    assert sorted((tuple(r[:1]) == (None,) and (-1, *r[1:]) or (r[0] or -1, *r[1:]) for r in got.collect()), key=repr) == plain_clusters(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.clusters(table.limit(0)).count() == 0


def test_elkan_passes_over_most_distances():
    rng = np.random.default_rng(1)
    centers = rng.integers(-400, 400, size=(16, 64)).astype(object)
    x = np.concatenate([c.astype(np.int64) + rng.integers(-20, 20, size=(100, 64)) for c in centers])
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), 16))
    first = centroids.assign(x, centers, cluster, upper, lower)
    new = centers + 1
    shift = centroids.moved(centers, new)
    before = cluster.copy()
    again = centroids.assign(x, new, cluster, upper + shift[cluster], np.maximum(lower - shift, 0))
    exact = np.array([[centroids.squared(x[i : i + 1], c)[0] for c in new] for i in range(len(x))])
    assert first < 16 * len(x) and again == 0 and (cluster == exact.argmin(axis=1)).all() and (before == cluster).all()
