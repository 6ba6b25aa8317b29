"""Near-duplicates by HyperMinHash (operator 5).

A document's set holds its distinct shingles of five lower-cased words.  Each
bucket of the sketch has its own hash of the shingles and keeps of the least
value only its count of leading zeros and ten mantissa bits, packed into 16
bits.  (Every bucket sees all shingles, so that short texts fill all buckets.)
Documents of equal sets are one class, stood for by its smallest id.  Bands of
three registers make candidate groups; inside each, block by block, the
Jaccard estimate, corrected for registers that are equal by chance, links what
may be similar into families; inside each family full sets confirm the links.
Components of confirmed links are the result.

At a similarity of 0.75 the bands miss a pair with a chance of about 2e-8 and
the estimate's cut (five standard deviations below) with about 1e-6.

Edge cases: null, empty and wordless texts have an empty set and are linked
with nothing; fewer than five words are one shingle; equal texts are linked;
repeated ids share one row's result; an empty table gives no rows; a
null id is left out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import mix64, text_or_empty, written
from tessella.llm.components import compare_groups, components

WORDS = 5
PERCENT = 75
BUCKETS, ROWS = 96, 3
MANTISSA = 10
CACHED_WORDS = 400_000
#: Chance that two registers of equal-sized, disjoint sets agree, times 4: a cell is on average 0.72 * 2^-10 of its own value wide.
CHANCE = 0.72 * 2.0**-MANTISSA
MULTIPLIERS = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Hashes(dict):
    """Hash of a word, remembered for some."""

    def __init__(self, kept: int = CACHED_WORDS) -> None:
        self.kept = kept

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.kept:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, known: _Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.  Bytes lower-case and split by ASCII alone, as the definition says."""
    own = text.encode().lower().split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, own), dtype=np.uint64, count=len(own))
    width = min(words, len(own))
    made = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        made *= np.uint64(0x9E3779B97F4A7C15)
        made += hashes[k : k + len(made)]
    return np.unique(mix64(made))


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa (10 bits) of 64-bit minima."""
    zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 63).astype(np.uint64)
    with np.errstate(over="ignore"):
        mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype("<u2")


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, [set, bucket]."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((BUCKETS, len(sets)), dtype=np.uint64)
    scratch = np.empty_like(every)
    for k, m in enumerate(MULTIPLIERS):
        np.multiply(every, m, out=scratch)
        least[k] = np.minimum.reduceat(scratch, starts)
    return np.ascontiguousarray(registers(least).T)


def sketches(docs: DataFrame, id_col: str, text_col: str, kept_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, size, digest, registers of every document; digest and registers are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes(kept_words)
        for batch in batches:
            ids, texts = batch.column("i"), batch.column("t")
            for a in range(0, len(ids), 500):
                sets = [shingles(t, known) for t in texts.slice(a, 500).to_pylist()]
                full = [s for s in sets if len(s)]
                rows = iter(sketch(full) if full else ())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                regs = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "size", "digest", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).where("i is not null")
    return rows.mapInArrow(run, "doc_id long, size long, digest binary, registers binary")


def least_matches(percent: int = PERCENT) -> float:
    """Matching share of registers below which a pair's estimate rules it out: five standard deviations."""
    j = percent / 100
    return j - 5 * math.sqrt(j * (1 - j) / BUCKETS)


def similar_sketches(percent: int):
    least = least_matches(percent)

    def links(columns: list) -> tuple[np.ndarray, np.ndarray]:
        regs = np.frombuffer(b"".join(columns[0]), dtype="<u2").reshape(-1, BUCKETS)
        size = np.array(columns[1], dtype=np.float64)
        found_a, found_b = [], []
        for a in range(len(regs) - 1):
            rest = slice(a + 1, None)
            chance = CHANCE * size[a] * size[rest] / (size[a] + size[rest]) ** 2
            estimate = ((regs[a] == regs[rest]).mean(axis=1) - chance) / (1 - chance)
            # Sets of too unequal sizes cannot reach the threshold.
            near = (estimate >= least) & (np.minimum(size[a], size[rest]) * 100 >= percent * np.maximum(size[a], size[rest]))
            at = np.flatnonzero(near)
            found_a.append(np.full(len(at), a))
            found_b.append(at + a + 1)
        return np.concatenate(found_a), np.concatenate(found_b)

    return links


def similar_sets(percent: int):
    def links(columns: list) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(s, dtype="<u8") for s in columns[0]]
        size = np.array([len(s) for s in sets])
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        holders = owner[order]  # documents by shingle, ascending
        first = np.searchsorted(at[order], np.arange(len(names) + 1))
        begin = np.concatenate([[0], np.cumsum(size)])
        found_a, found_b = [], []
        for a in range(len(sets) - 1):
            own = at[begin[a] : begin[a + 1]]
            lengths = first[own + 1] - first[own]
            where = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.bincount(holders[where], minlength=len(sets))
            near = np.flatnonzero(100 * common[a + 1 :] >= percent * (size[a] + size[a + 1 :] - common[a + 1 :]))
            found_a.append(np.full(len(near), a))
            found_b.append(near + a + 1)
        return np.concatenate(found_a), np.concatenate(found_b)

    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text", kept_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, of every document."""
    seen = written(sketches(docs, id_col, text_col, kept_words), "sketches")
    classes = written(seen.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("registers").alias("registers")), "classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // ROWS - 1)), lambda b: F.xxhash64(b, F.col("registers").substr(b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keys = classes.select("id", F.explode(bands).alias("g"))
    groups = keys.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(groups, "g").join(classes.select("id", "registers", "size"), "id")
    families = components(compare_groups(members, ["registers", "size"], similar_sketches(percent)))
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    known = families.join(sizes, "component").select("id", F.col("component").alias("g"), "n")
    # Merged at every size: one plan for small and large inputs.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).hint("merge").join(known, "id")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(kept_words)
        for batch in batches:
            sets = pa.array([shingles(t, hashes).astype("<u8").tobytes() for t in batch.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("n"), batch.column("id"), sets], names=["g", "n", "id", "shingles"])

    sets = texts.select("g", "n", "id", "t").mapInArrow(full, "g long, n long, id long, shingles binary")
    found = components(compare_groups(sets, ["shingles"], similar_sets(percent)))
    named = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = seen.select("doc_id", "size", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, kept_words: int = CACHED_WORDS) -> DataFrame:
    """One document of each component, with its columns as they were; rows without an id stay."""
    lost = near_duplicates(docs, percent, kept_words=kept_words).where("not kept").select(F.col("doc_id").alias("_lost_id"))
    return docs.join(lost, docs["doc_id"] == lost["_lost_id"], "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
