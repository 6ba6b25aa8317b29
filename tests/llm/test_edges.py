"""Null and repeated ids, repeated rows, megabyte texts, empty tables and foreign columns, for every operator over texts."""

import collections
import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, hyperminhash, license_scan, pii, telephony, toxicity

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{k % 977} and{k % 89}" for k in range(110_000)) + ".\nReleased under the MIT License.\ncall +1 (626) 555-5759"
ROWS = [(None, "a text without an id, released under the MIT License."), (None, "another"), (1, "the same row again and again"), (1, "the same row again and again"), (1, "one id, another text"), (2, LONG), (3, None), (4, "")]
COLUMNS = "doc_id long, text string, digest string, n long, size long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in ROWS], COLUMNS).repartition(3)


def plain(text):
    return text or ""


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_long_text_is_megabytes():
    assert len(LONG) > 1_500_000


def test_licenses(odd):
    assert counted(license_scan.scan(odd).select("doc_id", "license").collect()) == {(2, "mit-line"): 1}
    assert license_scan.scan(odd.where("doc_id is null").withColumn("text", F.lit("Released under the MIT License."))).select("doc_id", "license").distinct().collect() == [(None, "mit-line")]


def test_bpe(odd):
    code = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = counted(bpe.bpe_round_trip(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "n_tokens", "decoded_sha256").collect())
    assert got == counted((i, len(code.encode(plain(t))), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in ROWS)


def test_near_duplicates(odd):
    got = hyperminhash.near_duplicates(odd).collect()
    # A null id has no result; keep_one keeps its row.
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    assert all(r.component_id == r.doc_id and r.kept for r in got) and next(r.n_shingles for r in got if r.doc_id == 2) > 10_000
    assert hyperminhash.keep_one(odd).count() == len(ROWS)


def test_telephony(odd):
    got = counted(telephony.media_report(telephony.stored_pcm(telephony.store_media(odd))).select("doc_id", "n_bytes", "payload_sha256").collect())
    pad = lambda b: b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
    assert got == counted((i, len(plain(t).encode()), hashlib.sha256(pad(plain(t).encode())).hexdigest()) for i, t in ROWS)


def test_personal_data(odd):
    model = pii.fit(odd)
    got = counted(odd.select("doc_id", pii.spans_of(model, F.col("text")).alias("s")).select("doc_id", "s.n_phone", "s.n_email").collect())
    assert got == counted((i, int(t == LONG), 0) for i, t in ROWS)


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scores = odd.select("doc_id", "text", toxicity.score_of(model, F.col("text")).alias("s")).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.s <= 1 for r in scores) and len({r.s for r in scores if not r.text}) == 1
    assert toxicity.reject_toxic(odd, toxicity.fit(odd, labels.limit(0))).columns == odd.columns


@pytest.fixture
def tables(spark, tmp_path):
    def make(docs, labels):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        labels.write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


@pytest.mark.parametrize("case", ["no documents", "no labels", "odd rows"])
def test_pipeline(spark, odd, tables, case):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    folder = tables(odd.limit(0) if case == "no documents" else odd, labels.limit(0) if case != "odd rows" else labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), COLUMNS)
    # No row is toxic or near another, so all stay, less what later rows repeat.
    assert docs.count() == (0 if case == "no documents" else len(ROWS)) and docs.select("digest", "n", "size", "label").distinct().count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {i for r in packed for i in r.doc_ids} == ({i for i, _ in ROWS} if case != "no documents" else set())
