"""Telephony audio in columns (operator 7).

``store_media`` puts bytes into WAV files (a binary column) as 8-bit mu-law or
A-law samples or as IMA ADPCM blocks, without loss.  ``read_media`` parses such
files again; ``to_pcm`` expands mu-law and A-law by lookup tables, decodes
ADPCM with one numpy step for the same nibble of every block in a batch, and
resamples from 8 to 16 kHz.  ``stored_pcm`` reads such files, digests them and
returns the resampled PCM as a column; ``media_report`` adds digests of that.
``op7`` writes the files and then the PCM as tables in the shared folder, and
derives each from what it reads back.

Edge cases: a null or empty text is one block of padding; equal texts give
equal rows, except for their ids; bytes that are no WAV file of a known
format give null columns; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import text_or_empty, to_batch, written

#: Bytes of an ADPCM block, and of which a payload is a multiple.
BLOCK = 576
RATE, RESAMPLED = 8_000, 16_000
#: WAVE format tags (fixed values of the file format).
TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
#: Bytes handled together: enough blocks for numpy, little memory.
TOGETHER = 2_048 * BLOCK


def _mulaw() -> np.ndarray:
    x = ~np.arange(256, dtype=np.int32) & 255
    size = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    x = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (x & 15) << 4, x >> 4 & 7
    size = np.where(segment == 0, low + 8, low + 264 << np.maximum(segment - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
#: Step sizes of IMA ADPCM (fixed values of the standard).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
#: Change of the step index by a nibble's size (fixed values of the standard).
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """What nibble n adds at step index i, and the next index shifted by 4, both at i * 16 + n."""
    step, n = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(n & 4, step, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[None, :], 0, len(STEPS) - 1)
    return np.where(n & 8, -size, size).astype(np.int32).ravel(), (index << 4).astype(np.int32).ravel()


ADDED, NEXT = _ima_tables()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks: uint8 [blocks, bytes] to int16 [blocks, 2 * (bytes - 4) + 1]."""
    count, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) << 4
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (width - 4) + 1, count), dtype=np.int16)
    out[0] = value
    at = np.empty_like(index)
    for k in range(width - 4):
        for half, nibble in enumerate((data[k] & 15, data[k] >> 4)):
            np.bitwise_or(index, nibble, out=at)
            value += ADDED[at]
            np.maximum(value, -32768, out=value)
            np.minimum(value, 32767, out=value)
            index = NEXT[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation, in integers; the last sample is held."""
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[::2], out[1::2] = pcm, pcm
    out[1:-1:2] = pcm[:-1].astype(np.int32) + pcm[1:] >> 1
    return out


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def wav(payload: bytes, kind: str) -> bytes:
    """A mono WAV file of 8 kHz whose data are ``payload``."""
    if kind == "ima":
        samples = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", TAGS[kind], 1, RATE, RATE * BLOCK // samples, BLOCK, 4, 2, samples)
        count = len(payload) // BLOCK * samples
    else:
        form = struct.pack("<HHIIHHH", TAGS[kind], 1, RATE, RATE, 1, 8, 0)
        count = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[str, memoryview] | None:
    """Kind and data of a file; None if it is none of ours."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, kind, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        name = media[at : at + 4]
        if name == b"fmt " and size >= 2:
            (tag,) = struct.unpack_from("<H", media, at + 8)
            kind = next((k for k, v in TAGS.items() if v == tag), None)
        elif name == b"data":
            return (kind, view[at + 8 : at + 8 + size]) if kind and at + 8 + size <= len(media) else None
        at += 8 + size + size % 2
    return None


def to_pcm(kind: str, payload: bytes | memoryview) -> np.ndarray:
    """Resampled PCM of one file's data; an incomplete last ADPCM block is left out."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    if kind == "ima":
        return resample(ima_decode(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel())
    return resample((MULAW if kind == "mulaw" else ALAW)[raw])


def store_media(docs: DataFrame, kind: str = "mulaw", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as a WAV file.

    Inside a partition, texts go by their bytes a character and then by themselves: those of one alphabet and
    language, and copies, stand together and compress better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").cast(pa.binary())
            ids, size = batch.column("i"), 256
            for a in range(0, len(texts), size):
                own = texts.slice(a, size).to_pylist()
                yield pa.RecordBatch.from_arrays([ids.slice(a, size), pa.array([len(x) for x in own], pa.int64()), pa.array([wav(pad(x), kind) for x in own], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t"))
    # a column of its own: a sort evaluates an expression again at every comparison
    rows = rows.withColumn("alphabet", F.round(F.octet_length("t") / F.greatest(F.length("t"), F.lit(1)) * 100))
    return rows.sortWithinPartitions("alphabet", "t").select("i", "t").mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
])
STORED = T.StructType([*DIGESTS.fields, T.StructField("others", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
REPORT = T.StructType([*DIGESTS.fields, T.StructField("feature", T.StringType())])


def _feature(name: str, twice: np.ndarray) -> str:
    """Of resampled PCM: number of samples, checksum, and mean loudness of the samples as decoded."""
    level = int(np.abs(twice[::2].astype(np.int32)).sum(dtype=np.int64)) // max(1, len(twice) // 2)
    return f"{name}:{len(twice)}:{zlib.crc32(twice.tobytes()):08x}:{level}"


def stored_pcm(media: DataFrame) -> DataFrame:
    """Digests of each file as read, its resampled PCM (16-bit samples, little-endian) with its rate, and ``others``: features of its data as A-law and ADPCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(STORED)

        def rows(group: list[tuple]) -> pa.RecordBatch:
            found = [read_wav(m) for _, _, m in group]
            raw = [np.frombuffer(f[1], dtype=np.uint8) for f in found if f]
            blocks = [x[: len(x) // BLOCK * BLOCK] for x in raw]
            adpcm, at, decoded = ima_decode(np.concatenate(blocks).reshape(-1, BLOCK)) if blocks else None, 0, iter(raw)
            out: dict[str, list] = {name: [] for name in arrow.names}
            for (i, n, m), f in zip(group, found, strict=True):
                p = others = pcm = None
                if f:
                    kind, p = f
                    x = next(decoded)
                    own = adpcm[at : at + len(x) // BLOCK].ravel()
                    at += len(x) // BLOCK
                    others = _feature("a", resample(ALAW[x])) + ";" + _feature("i", resample(own))
                    pcm = (resample(own) if kind == "ima" else to_pcm(kind, p)).tobytes()
                values = (i, n, f and len(p), f and hashlib.sha256(p).hexdigest(), f and zlib.crc32(p[-32:]), m and len(m), m and hashlib.sha256(m).hexdigest(), others, RESAMPLED if f else None, pcm)
                for name, value in zip(arrow.names, values, strict=True):
                    out[name].append(value)
            return to_batch(arrow, out)

        group, size = [], 0
        for batch in batches:
            for i, n, m in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                group.append((i, n, m.as_py()))
                size += len(group[-1][2] or b"")
                if size >= TOGETHER:
                    yield rows(group)
                    group, size = [], 0
        if group:
            yield rows(group)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, STORED)


def media_report(stored: DataFrame) -> DataFrame:
    """Digests of stored files and features of their stored PCM, from the samples as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature = [pcm.is_valid and _feature("pcm", np.frombuffer(pcm.as_buffer(), dtype="<i2")) + ";" + other or None for pcm, other in zip(batch.column("pcm"), batch.column("others").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DIGESTS.names), pa.array(feature, pa.string())], names=REPORT.names)

    return stored.select(*DIGESTS.names, "others", "pcm").mapInArrow(run, REPORT)


def in_shared_folder(table: DataFrame, name: str) -> DataFrame:
    """Large binary values, compressed well and in small row groups."""
    return written(table, name, **{"compression": "zstd", "parquet.compression.codec.zstd.level": "11", "parquet.block.size": str(16 << 20), "parquet.page.size": str(4 << 20), "parquet.enable.dictionary": "false"})


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = in_shared_folder(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), "mulaw"), "media")
    return media_report(in_shared_folder(stored_pcm(media), "pcm"))
