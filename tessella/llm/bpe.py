"""Byte-level BPE encoding and decoding (operator 2).

A text becomes overlapping chunks, which are rows of their own, so that one
very long text is spread over tasks.  Where two chunks overlap, both are split
into pre-tokens from their own starts, which may lie inside a pre-token.  They
are stitched at the first boundary that both have and that no start could
move: after a letter or digit that another class follows, or between a
character and white space (no pre-token spans these).  From there on both
agree, since a pre-token depends on nothing before it.  A task computes both
cuts of its chunk alone, from the overlaps on its two sides, and encodes the
pieces between them.

The streams of ids of one text are joined in order by a sorted shuffle on the
document, which carries ids only for texts of more than one chunk.

Edge cases: null and empty texts have no tokens and the digests of empty
strings; where an overlap has no common boundary (one run longer than it), the
two chunks' texts are joined again before they are encoded; repeated ids are
told apart by their row, so repeated rows give repeated results; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import text_or_empty, to_batch

#: Characters of a chunk without its overlaps, and of an overlap.
CHUNK, OVERLAP = 60_000, 1_000
#: Words whose ids a worker remembers before it forgets them all.
CACHED_WORDS = 400_000

#: White space as the pattern's \\s means it (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for Arrow's regular expressions.
ARROW_SPACE = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", SPACE)


class _Known(dict):
    """Ids of words; what is missing is encoded."""

    def __init__(self, encode, before: str) -> None:
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(self.encode(self.before + word))
        return found


class Codec:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_to_array = encoding.encode_ordinary, encoding.encode_to_numpy
        self.pretoken = regex.compile(pattern)
        self.fixed = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})")
        self.run = re.compile(rf"[{SPACE}]{{2}}").search
        #: Texts with white space at an end or next to other white space.
        self.loose = f"^[{ARROW_SPACE}]|[{ARROW_SPACE}][{ARROW_SPACE}]|[{ARROW_SPACE}]$"
        top = max(ranks.values()) + 1
        self.bytes_of = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.first_byte = np.array([token[0] if token else 0 for token in self.bytes_of], dtype=np.uint8)
        self.text_of = [str(i) for i in range(top)]
        self.first, self.after = _Known(self.encode, ""), _Known(self.encode, " ")

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.pretoken.finditer(text)]

    def stitch(self, before: str, overlap: str) -> int | None:
        """Where in ``overlap`` the chunk on its left hands over to the one that starts with it."""
        left = {p - len(before) for p in self.boundaries(before + overlap)}
        common = left.intersection(self.boundaries(overlap))
        return min((m.start() for m in self.fixed.finditer(overlap) if m.start() in common), default=None)

    def ids(self, text: str) -> list[int]:
        """Ids of a text that begins and ends at pre-token boundaries.

        A space with no white space beside it always belongs to the pre-token
        after it, so a text without two white-space characters in a row may be
        cut before each space, and the pieces repeat.  A run of them may be one
        pre-token, whatever they are, so other texts are encoded whole.
        """
        if not text:
            return []
        if self.run(text):
            return self.encode(text)
        words = text.split(" ")
        return list(chain(self.first[words[0]], chain.from_iterable(map(self.after.__getitem__, words[1:]))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (row, i, part, parts, lead, body, tail): a text's chunks with an overlap on each side."""
    text = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.length("t") / chunk)).cast("int"))
    rows = text.withColumn("row", F.when(F.col("parts") > 1, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    rows = rows.select("row", "i", "t", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    whole, start = F.col("parts") == 1, F.col("part") * chunk
    return rows.select(
        "row", "i", "part", "parts",
        F.when(whole | (F.col("part") == 0), "").otherwise(F.expr(f"substring(t, part * {chunk} + 1 - {overlap}, {overlap})")).alias("lead"),
        F.when(whole, F.col("t")).otherwise(F.substring("t", start + 1, F.lit(chunk))).alias("body"),
        F.when(whole, "").otherwise(F.substring("t", start + 1 + chunk, F.lit(overlap))).alias("tail"),
    )


CODED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("i", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("parts", T.IntegerType()),
    T.StructField("n", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("ids", T.BinaryType()),
])
OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_chunks(chunks: DataFrame, ranks_path: str, pattern: str, overlap: int) -> DataFrame:
    """Ids of each chunk's own share of its text; digests alone where the chunk is the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        code, arrow = codec(ranks_path, pattern), to_arrow_schema(CODED)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in arrow.names}
            keys = [batch.column(name).to_pylist() for name in ("row", "i", "part", "parts")]
            for row, i, part, parts, lead, body, tail in zip(*keys, *(batch.column(c).to_pylist() for c in ("lead", "body", "tail")), strict=True):
                a = b = ids = None
                if parts == 1:
                    ids = code.ids(body)
                    a = hashlib.sha256(code.joined(ids).encode()).hexdigest()
                    b = hashlib.sha256(code.decode(ids)).hexdigest()
                else:
                    begin = 0 if part == 0 else code.stitch(lead, body[:overlap])
                    end = len(tail) if part + 1 == parts or len(tail) < overlap else code.stitch(body[-overlap:], tail)
                    own = "" if part and len(body) < overlap else body[begin or 0 :] + tail[: end or 0]
                    if begin is None or end is None:
                        a, b = own, "open" if end is None else None
                    else:
                        ids = code.ids(own)
                whole = parts == 1 or ids is None
                for name, value in zip(arrow.names, (row, i, part, parts, len(ids or ()), a, b, None if whole else np.array(ids, dtype="<u4").tobytes()), strict=True):
                    out[name].append(value)
            yield to_batch(arrow, out)

    return chunks.mapInArrow(run, CODED)


def join_chunks(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row a text, from its chunks in order; holds one text's hashes at a time."""
    ordered = coded.repartition("i", "row").sortWithinPartitions("i", "row", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        code, arrow = codec(ranks_path, pattern), to_arrow_schema(OUT)
        ids_hash = raw_hash = None
        count, pending = 0, ""
        for batch in batches:
            out: dict[str, list] = {name: [] for name in arrow.names}
            for _, i, part, parts, n, a, b, ids_bytes in zip(*(batch.column(name).to_pylist() for name in CODED.names), strict=True):
                if parts > 1:
                    if part == 0:
                        ids_hash, raw_hash, count, pending = hashlib.sha256(), hashlib.sha256(), 0, ""
                    if ids_bytes is None:
                        pending += a
                        ids = []
                        if b is None:
                            ids, pending = code.ids(pending), ""
                    else:
                        ids = np.frombuffer(ids_bytes, dtype="<u4").tolist()
                    if ids:
                        ids_hash.update(((" " if count else "") + code.joined(ids)).encode())
                        raw_hash.update(code.decode(ids))
                        count += len(ids)
                    if part + 1 < parts:
                        continue
                    n, a, b = count, ids_hash.hexdigest(), raw_hash.hexdigest()
                for name, value in zip(arrow.names, (i, n, a, b), strict=True):
                    out[name].append(value)
            yield to_batch(arrow, out)

    return ordered.mapInArrow(run, OUT)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    if chunk < 2 * overlap:
        raise ValueError("a chunk must be at least two overlaps long")
    chunks = chunk_rows(docs, id_col, text_col, chunk, overlap)
    return join_chunks(encode_chunks(chunks, ranks_path, pattern, overlap), ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every text, each encoded in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        for batch in batches:
            ids = pa.array([code.ids(t) for t in batch.column("t").to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``data``: the raw bytes of the ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        for batch in batches:
            data = pa.array([code.decode(x or []) for x in batch.column("ids").to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], names=["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
