"""Best-fit packing into sequences of several permitted lengths (operator 4).

Texts become token ids, by the ranks of a byte-level BPE file, and then pieces
of at most the longest permitted length.  Pieces are dealt into shards by their
own number, so that a shard holds about ``SHARD`` of them whatever their keys,
and never more ids than that times the longest length.  Each shard is packed on
its own: pieces in descending order of size go to the open bin that they fill
best.  Where none has room, every permitted length is filled on trial from the
sizes still to come, and the one is opened whose cost per token held is least;
bins of all permitted lengths take part together.  Pieces that a trial counted on
may fit another bin better, so at the end each bin is downsized to the shortest
permitted length that holds its contents.  The result is the sequences: their
ids, and whose they are.

Edge cases: null and empty texts have no tokens and get one row with no bin;
pieces of equal size go in the order of document, piece and row; repeated rows
are packed each; very long texts are cut into as many pieces as they need; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import by_bytes, spelled, text_or_empty, written
from tessella.llm.bpe import Codec, codec

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces of a shard on average: bounds a task's memory (33 MB of ids at most); the loss at a shard's end is a few bins.
SHARD = 4_000
#: Words of texts with white space at an end whose ids a worker remembers, of each kind, before it forgets them: time against memory.
KEPT_WORDS = 300_000
#: Bytes of texts whose different words are encoded together: time against memory.
TOGETHER = 8 << 20
#: A bin costs its length times (1 + length / ATTENTION): attention grows with the square of it.
ATTENTION = 65_536
PIECES = "doc_id long, piece int, first_token long, n_tokens int, ids binary"
#: Lists hold one entry a piece, in the order in which the pieces stand in the bin.
SEQUENCES = "bin_id long, bin_capacity int, n_tokens int, doc_ids array<long>, pieces array<int>, first_tokens array<long>, lengths array<int>, ids array<int>"
MADE = pa.schema([("bin_id", pa.int64()), ("bin_capacity", pa.int32()), ("n_tokens", pa.int32()), *((name, pa.list_(kind)) for name, kind in (("doc_ids", pa.int64()), ("pieces", pa.int32()), ("first_tokens", pa.int64()), ("lengths", pa.int32()), ("ids", pa.int32())))])


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


def trial(room: int, counts: Sequence[int], present: int) -> int:
    """Tokens that fill ``room`` from the sizes still to come, the largest that fits first.

    ``counts`` holds how many pieces of a size there are, ``present`` has a bit for each size with any.
    """
    held = 0
    while fitting := present & ((2 << room) - 1):
        size = fitting.bit_length() - 1
        taken = min(counts[size], room // size) * size
        held += taken
        room -= taken
        present = fitting ^ (1 << size)
    return held


def opened(size: int, lengths: Sequence[int], counts: Sequence[int], present: int) -> int:
    """The length to open for a piece: least cost per token of what a trial fill leaves in it."""
    best, best_price = 0, 0.0
    for c in lengths:
        if c >= size:
            held = size + trial(c - size, counts, present)
            price = cost(next(x for x in lengths if x >= held)) / held
            if not best or price < best_price:
                best, best_price = c, price
    return best


def pack(sizes: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, final capacity of it and offset in it, for sizes in descending order."""
    lengths = sorted(capacities)
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # bins by what is left in them
    open_rooms = 0  # bit r: some bin has r left
    filled: list[int] = []
    capacity_of: list[int] = []
    counts = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()  # pieces still to come, by size
    present = sum(1 << s for s, n in enumerate(counts) if n)  # bit s: some piece of size s is still to come
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int32)
    for k, size in enumerate(sizes.tolist()):
        counts[size] -= 1
        if not counts[size]:
            present ^= 1 << size
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            own = len(filled)
            left = opened(size, lengths, counts, present)
            filled.append(0)
            capacity_of.append(left)
        bins[k], offsets[k] = own, filled[own]
        filled[own] += size
        left -= size
        if left:
            room[left].append(own)
            open_rooms |= 1 << left
    final = np.array([next(c for c in lengths if c >= f) for f in filled], dtype=np.int32)
    return bins, final[bins] if len(final) else np.empty(0, np.int32), offsets


class _Raw(dict):
    """Ids of words as little-endian bytes; what is missing is encoded.

    Letters and the stops after them are always different pre-tokens, so such words are put together from ``tails``.
    """

    def __init__(self, code: Codec, before: str, dtype: np.dtype, kept: int, tails: _Raw | None = None) -> None:
        self.encode, self.before, self.dtype, self.kept, self.tails = code.encode, before, dtype, kept, self if tails is None else tails

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.kept:
            self.clear()
        stem = word.rstrip(".,;:!?")
        if len(stem) < len(word) and stem.isalpha():
            found = self[stem] + self.tails[word[len(stem) :]]
        else:
            found = np.array(self.encode(self.before + word), dtype=self.dtype).tobytes()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def _raw(ranks_path: str, pattern: str, kept: int = KEPT_WORDS) -> tuple[_Raw, _Raw]:
    """Words at the start of a text and after a space; a worker keeps them from task to task."""
    code = codec(ranks_path, pattern)
    first = _Raw(code, "", id_type(code), kept)
    return first, _Raw(code, " ", id_type(code), kept, first)


def id_type(code: Codec) -> np.dtype:
    return np.dtype("<u2") if len(code.bytes_of) <= 1 << 16 else np.dtype("<u4")


def together(texts: pa.Array, code: Codec) -> list[np.ndarray]:
    """Ids of texts whose white-space characters all stand alone and inside, from one encoding of their different words.

    There a space begins the pre-token it stands in and a line feed is one, so texts may be cut before both, and words
    that begin with either may be put in any order.  Each text gets a line feed in front, whose id is left out again.
    """

    def ids_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
        ids = code.encode_to_array("".join(marked.to_pylist()), disallowed_special=())
        starts = np.flatnonzero(np.isin(code.first_byte[ids], (32, 10)))
        if len(starts) != len(words):
            raise ValueError("words and their first ids do not match")
        return ids.astype(id_type(code)), np.diff(starts, append=len(ids))

    lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
    return [ids[1:] for ids in spelled(pc.split_pattern(lines, " "), ids_of)]


def pieces(docs: DataFrame, longest: int, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, ids; one row without ids for a text without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        dtype, (first, after) = id_type(code), _raw(ranks_path, pattern, kept_words)
        step = longest * dtype.itemsize
        def alone(text: str) -> bytes:
            if code.run(text):
                return np.array(code.encode(text), dtype=dtype).tobytes()
            words = text.split(" ")
            return b"".join(chain((first[words[0]],), map(after.__getitem__, words[1:])))

        for batch in batches:
            rows, numbers = [], iter(batch.column("i").to_pylist())
            for texts in by_bytes(batch.column("t"), TOGETHER):
                loose = pc.match_substring_regex(texts, code.loose)
                others, plain = iter(texts.filter(loose).to_pylist()), iter(together(texts.filter(pc.invert(loose)), code))
                for odd in loose.to_pylist():
                    ids = alone(next(others)) if odd else next(plain).tobytes()
                    i = next(numbers)
                    for k, at in enumerate(range(0, max(1, len(ids)), step)):
                        own = ids[at : at + step]
                        rows.append((i, k, k * longest, len(own) // dtype.itemsize, own))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "piece", "first_token", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, PIECES)


def sequences(rows: pa.Table, shard: int, lengths: Sequence[int], dtype: np.dtype) -> pa.Table:
    """One row a bin from the pieces of a shard, and one a piece without tokens."""
    full = rows.filter(pc.greater(rows["n_tokens"], 0)).sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("number", "ascending")])
    bins, final, _ = pack(full["n_tokens"].to_numpy(), lengths)
    order = np.argsort(bins, kind="stable")  # pieces keep their order inside a bin
    cuts = np.append(np.flatnonzero(np.diff(bins[order], prepend=-1)), len(bins))  # where bins start, and the end
    held = full.take(pa.array(order)).combine_chunks()
    stops = np.concatenate([[0], np.cumsum(held["n_tokens"].to_numpy(), dtype=np.int64)])[cuts]
    ids = np.frombuffer(b"".join(held["ids"].to_pylist()), dtype=dtype).astype(np.int32)
    firsts = order[cuts[:-1]]
    empty = rows["doc_id"].filter(pc.equal(rows["n_tokens"], 0))
    lone, none = [np.arange(len(empty) + 1), np.zeros(len(empty), dtype=np.int64)], pa.nulls(len(empty))
    kinds = dict(zip(MADE.names, MADE.types, strict=True))

    def lists(name: str, values: pa.ChunkedArray | np.ndarray, ends: np.ndarray) -> pa.Array:
        flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.cast(kinds[name].value_type)).cast(kinds[name])

    made = [
        [(shard << 32) + bins[firsts], final[firsts], np.diff(stops), *(lists(name, held[c], cuts) for name, c in (("doc_ids", "doc_id"), ("pieces", "piece"), ("first_tokens", "first_token"), ("lengths", "n_tokens"))), lists("ids", ids, stops)],
        [none, none, lone[1], lists("doc_ids", empty, lone[0]), *(lists(name, lone[1], lone[0]) for name in ("pieces", "first_tokens", "lengths")), lists("ids", ids[:0], np.zeros(len(empty) + 1))],
    ]
    return pa.concat_tables([pa.Table.from_arrays([pa.array(x).cast(kind) for x, kind in zip(columns, MADE.types, strict=True)], schema=MADE) for columns in made])


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacities: Sequence[int] = CAPACITIES, *, shard: int = SHARD, kept_words: int = KEPT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a sequence: its bin, capacity and ids, and document, piece, first token and length of each of its pieces."""
    lengths = sorted(set(capacities))
    if not lengths or lengths[0] < 1:
        raise ValueError("capacities must be positive")
    dtype = id_type(codec(ranks_path, pattern))
    # A piece's number is written with it, so that a task that is run again deals alike.
    rows = written(pieces(docs, lengths[-1], ranks_path, pattern, id_col, text_col, kept_words).withColumn("number", F.monotonically_increasing_id()), "pieces", **{"parquet.block.size": str(16 << 20)})
    shards = max(1, -(-rows.count() // shard))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))

    def run(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        return sequences(own, key[0].as_py(), lengths, dtype)

    return keyed.groupBy("shard").applyInArrow(run, SEQUENCES)


def placements(packed: DataFrame) -> DataFrame:
    """One row a piece: doc_id, piece, first_token, n_tokens, bin_id, bin_capacity, bin_offset."""
    before = F.transform("lengths", lambda _, k: F.aggregate(F.slice("lengths", F.lit(1), k), F.lit(0), lambda a, n: a + n))
    zipped = packed.select("bin_id", "bin_capacity", F.explode(F.arrays_zip("doc_ids", "pieces", "first_tokens", "lengths", before.alias("before"))).alias("p"))
    return zipped.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.first_tokens").alias("first_token"), F.col("p.lengths").alias("n_tokens"), "bin_id", "bin_capacity", F.when(F.col("bin_id").isNotNull(), F.col("p.before")).alias("bin_offset"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
