"""Near-duplicates by SimHash and multi-index hashing (operator 12).

A text's fingerprint has a bit where more than half of its three-word shingles,
repeats included, have it in their 64-bit hash.  Fingerprints that differ in few
bits are linked: the bits are dealt into segments, and by the pigeonhole one
segment of any such pair differs in so few bits that a small Hamming ball around
one fingerprint's segment holds the other's.  So every distinct fingerprint is
entered into a table for each of its segments, and asks for the ball's members;
what shares an entry is compared over all bits.  With two segments and a distance
of two the first has a ball of radius one and the second one of radius zero.

Documents of one fingerprint are a class, so copies cost one row each and nothing
is compared twice.  Entries with many fingerprints are split into blocks and
compared block by block; only spanning stars leave a task.  Texts of any length
are hashed in bounded pieces.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked
like any other; fewer than three words are one shingle; every row has a result of
its own, also repeated ids; a row with a null id keeps its fingerprint and gets the
smallest id that it can reach, null where there is none; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import dropped, text_or_empty, written
from tessella.llm.components import compare_groups, components

WORDS, SEED, BITS = 3, 42, 64
DISTANCE, SEGMENTS = 2, 2
#: Shingles whose bits are counted together.
TOGETHER = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority of each bit over the hashes of all shingles; bytes lower-case and split by ASCII alone, as the definition says."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split()
    if not own:
        return 0
    joined, width = b" ".join(own), min(words, len(own))
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, count=len(own)) + 1)
    starts, ends = np.concatenate([[0], ends[: len(own) - width]]).tolist(), (ends[width - 1 :] - 1).tolist()
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), TOGETHER):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + TOGETHER], ends[at : at + TOGETHER], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fingerprint (a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("t")), np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, "doc_id long, fingerprint long")


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment, so that a pair within ``distance`` meets in one of them."""
    edges = [BITS * k // count for k in range(count + 1)]
    whole, rest = divmod(distance, count)
    # More than each of these radii in every segment would be more than the distance in all.
    return [(a, b - a, whole if k <= rest else whole - 1) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if k <= rest or whole]


def index_rows(distinct: DataFrame, distance: int, count: int) -> DataFrame:
    """g, id, asks: the entries of each fingerprint (asks = 0) and the members of its balls (asks = 1)."""
    made = []
    for k, (first, bits, radius) in enumerate(segments(distance, count)):
        own = F.shiftrightunsigned("fingerprint", first).bitwiseAND(F.lit((1 << bits) - 1))
        flips = {0}
        for _ in range(radius):
            flips |= {f ^ (1 << b) for f in flips for b in range(bits)}
        # A segment's value and number in one long.
        made += [F.struct((own.bitwiseXOR(F.lit(f)) * count + k).alias("g"), F.lit(int(f != 0)).alias("asks")) for f in sorted(flips)]
    return distinct.select(F.col("fingerprint").alias("id"), F.inline(F.array(*made)))


def near(distance: int):
    """Positions of entries and of rows near them; two rows that only ask meet elsewhere."""

    def links(columns: list) -> tuple[np.ndarray, np.ndarray]:
        prints, asks = np.array(columns[0], dtype=np.int64), np.array(columns[1])
        found_a, found_b = [], []
        for a in np.flatnonzero(asks == 0).tolist():
            at = np.flatnonzero(np.bitwise_count((prints ^ prints[a]).view(np.uint64)) <= distance)
            at = at[at != a]
            found_a.append(np.full(len(at), a))
            found_b.append(at)
        if not found_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_a), np.concatenate(found_b)

    return links


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row; ``count`` segments, two at least."""
    seen = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(seen.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    index = written(index_rows(classes, distance, count), "fingerprint-index")
    met = index.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("asks") == 0).alias("entries")).where("n > 1 AND entries > 0").select("g", "n")
    members = index.join(met, "g").select("g", "n", "id", F.col("id").alias("print"), "asks")
    links = written(compare_groups(members, ["print", "asks"], near(distance)), "fingerprint-links")
    dropped(index)
    root = F.coalesce("component", "fingerprint")
    named = classes.join(components(links).withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select("fingerprint", root.alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint that very many documents share is one row on the right; the optimizer splits the left.
    of = named.join(ids, "root").select("fingerprint", "component_id")
    return seen.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
