"""Repeated passages by a depth-limited radix sort of suffixes (operator 3).

Suffixes of all texts, as bytes, are ordered only through ``threshold`` bytes,
by passes over digits, the most significant first; groups that are equal after
the last digit are exactly the repeated windows, and all of a group's members
but the first lose their bytes.  Groups of one leave after each pass.

* The first digit is the hash of a 24-byte stretch at the window's anchor, the
  leftmost least such hash inside it.  The anchor depends on the window's bytes
  alone, so equal windows share digit and distance; windows with one anchor lie
  side by side and travel as one row (about one in 35 bytes).
* The second digit is the hash of all bytes that a row's windows cover.  Rows
  equal in both are equal in every window.
* Rows that agree in the first digit only (at the edges of passages) are
  resolved by the third: the windows themselves, from the texts.

Hot passages: each task keeps of equal rows only the first and settles the
others itself, so what meets in one place grows with tasks, not with rows.
Where a first digit still has many different rows, its windows are dealt out by
their own hash; the result is the same.

Equality: the second pass compares 64 bits of the stretch at the anchor and 64
bits of all covered bytes; the third pass compares two independent 64-bit hashes
of the whole window.  Within one first digit, n different rows are taken for
equal by mistake with a chance below n^2 / 2^65.

A document is an id with a text: ``(doc_id, hash of the text)`` names it
everywhere, and documents are ordered by it.

Edge cases: null, empty and short texts lose nothing; matches never cross
documents; equal texts of at least ``threshold`` bytes under different ids lose
everything but the first; rows of one id with different texts are different
documents, ordered by their texts' hashes (``xxhash64``); rows that repeat both id
and text are one document, read several times: no row is earlier than the other,
none loses anything to the other, and all get the same result; an empty table
gives no rows; a null id counts as the smallest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import mix64, text_or_empty, written
from tessella.llm.repeats_kernel import DIGIT, anchors, window_hashes

THRESHOLD = 100
#: Different rows of one first digit beyond which its windows are dealt out one by one.
MANY = 2_000
#: Bytes of texts that a task hashes at a time, and whose rows it keeps until it deals them out.
TOGETHER, DEALT = 1 << 20, 16 << 20
NULL_ID = -(1 << 63)
WINDOW = np.dtype([("a", "<i8"), ("b", "<i8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i8")])
ROW = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<u4"), ("before", "u1"), ("count", "u1")])
DONE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("count", "u1")])


def _packed(rows: np.ndarray) -> bytes:
    """Field by field, which compresses better."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(data) // dtype.itemsize
    out, at = np.empty(n, dtype=dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize * n
        out[name] = np.frombuffer(data[at : at + size], dtype=dtype[name])
        at += size
    return out


def _rows(texts: list[bytes], names: list[tuple[int, int]], threshold: int) -> np.ndarray:
    """Every anchor of some texts with the windows that it stands for."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    digit, window = window_hashes(data, (DIGIT, threshold))
    parts, at = [], 0
    for text, (i, tie) in zip(texts, names, strict=True):
        n = len(text)
        if n >= threshold:
            place, first, last = anchors(digit[at : at + n - DIGIT + 1], threshold)
            own = np.empty(len(place), dtype=ROW)
            own["key"], own["doc"], own["tie"], own["at"] = digit[at + place], i, tie, place
            own["before"], own["count"] = place - first, last - first + 1
            shape = own["before"].astype(np.uint64) << np.uint64(8) | own["count"].astype(np.uint64)
            own["seg"] = mix64(window[at + first] + mix64(window[at + last] ^ shape))
            parts.append(own)
        at += n
    return np.concatenate(parts) if parts else np.empty(0, dtype=ROW)


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by digits, then place; where a new key begins; where a new (key, seg) begins."""
    rows = rows[np.lexsort((rows["at"], rows["tie"], rows["doc"], rows["seg"], rows["key"]))]
    if len(rows):
        # The same place read twice, from rows that repeat id and text, is one window.
        rows = rows[np.concatenate([[True], np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("at", "tie", "doc", "seg", "key")])])]
    key = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.empty(0, bool)
    seg = key | np.concatenate([[True], rows["seg"][1:] != rows["seg"][:-1]]) if len(rows) else key
    return rows, key, seg


def _settled(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=DONE)
    out["doc"], out["tie"], out["start"], out["count"] = rows["doc"], rows["tie"], rows["at"] - rows["before"], rows["count"]
    return out


def first_digits(texts: DataFrame, threshold: int, parts: int) -> DataFrame:
    """(p, rows, done): anchors dealt by their first digit, and windows that a task has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(parts_: list[np.ndarray]) -> pa.RecordBatch | None:
            rows, _, seg = _ordered(np.concatenate(parts_))
            if not len(rows):
                return None
            done, rows = _settled(rows[~seg]), rows[seg]
            p = (mix64(rows["key"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            cuts = np.searchsorted(p[order], np.arange(parts + 1))
            share = np.linspace(0, len(done), parts + 1).astype(int)
            kept = [k for k in range(parts) if cuts[k] < cuts[k + 1] or share[k] < share[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([_packed(rows[order[cuts[k] : cuts[k + 1]]]) for k in kept], pa.binary()), pa.array([_packed(done[share[k] : share[k + 1]]) for k in kept], pa.binary())], names=["p", "rows", "done"])

        made, held, names, size, total = [], [], [], 0, 0
        for batch in batches:
            for i, tie, t in zip(batch.column("i").to_pylist(), batch.column("tie").to_pylist(), batch.column("t"), strict=True):
                data = t.as_buffer()
                if len(data) < threshold:
                    continue
                held.append(data.to_pybytes())
                names.append((i, tie))
                size += len(data)
                if size >= TOGETHER:
                    made.append(_rows(held, names, threshold))
                    total += size
                    held, names, size = [], [], 0
                    if total >= DEALT:
                        if out := deal(made):
                            yield out
                        made, total = [], 0
        if held:
            made.append(_rows(held, names, threshold))
        if made and (out := deal(made)):
            yield out

    return texts.mapInArrow(run, "p int, rows binary, done binary")


#: span packs a first window start and a count of windows: start * 256 + count; key, at and many are null for settled windows.
SECOND = "doc long, tie long, span long, key long, at long, many boolean"
SPANS = "doc long, tie long, span long"


def second_digits(dealt: DataFrame, parts: int) -> DataFrame:
    """Settled windows, and the rows that agree with others in the first digit only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolve(rows: list[bytes], done: list[bytes]) -> Iterator[pa.RecordBatch]:
            own, key, seg = _ordered(np.concatenate([_unpacked(r, ROW) for r in rows]))
            settled = [_unpacked(d, DONE) for d in done]
            if len(own):
                group = np.cumsum(key) - 1
                different = np.bincount(group, weights=seg)[group]
                settled.append(_settled(own[~seg]))
                open_ = seg & (different > 1)
                left, many = own[open_], different[open_] > MANY
            else:
                left, many = own, np.empty(0, bool)
            flat, names = np.concatenate(settled), ["doc", "tie", "span", "key", "at", "many"]
            rest = _settled(left)
            for a in range(0, len(flat), 500_000):
                x = flat[a : a + 500_000]
                nothing = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["tie"]), pa.array(x["start"].astype(np.int64) << 8 | x["count"]), nothing, nothing, pa.nulls(len(x), pa.bool_())], names=names)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(rest["doc"]), pa.array(rest["tie"]), pa.array(rest["start"].astype(np.int64) << 8 | rest["count"]), pa.array(left["key"].view(np.int64)), pa.array(left["at"].astype(np.int64)), pa.array(many)], names=names)

        p, rows, done = None, [], []
        for batch in batches:
            for k, r, d in zip(batch.column("p").to_pylist(), batch.column("rows").to_pylist(), batch.column("done").to_pylist(), strict=True):
                if k != p and p is not None:
                    yield from resolve(rows, done)
                    rows, done = [], []
                p = k
                rows.append(r)
                done.append(d)
        if p is not None:
            yield from resolve(rows, done)

    return dealt.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(run, SECOND)


def contexts(texts: DataFrame, left: DataFrame, threshold: int) -> DataFrame:
    """(key, many, doc, tie, start, gap, bytes): the bytes under the windows of rows that are still open."""
    lists = left.groupBy(F.col("doc").alias("i"), "tie").agg(F.collect_list(F.struct("span", "key", "at", "many")).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("key", "many", "doc", "tie", "start", "gap", "bytes")}
            for doc, tie, text, rows in zip(batch.column("i").to_pylist(), batch.column("tie").to_pylist(), batch.column("t"), batch.column("open").to_pylist(), strict=True):
                # Rows that repeat a document stand side by side after the join; what still repeats, the third pass drops.
                if (doc, tie) == before:
                    continue
                before, data = (doc, tie), memoryview(text.as_buffer())
                for r in rows:
                    start, count = r["span"] >> 8, r["span"] & 255
                    for name, value in zip(out, (r["key"], r["many"], doc, tie, start, r["at"] - start, bytes(data[start : start + count + threshold - 1])), strict=True):
                        out[name].append(value)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return texts.join(lists, ["i", "tie"]).select("i", "tie", "t", "open").mapInArrow(run, "key long, many boolean, doc long, tie long, start long, gap long, bytes binary")


def _windows(batch: pa.RecordBatch, threshold: int) -> np.ndarray:
    """Two digests, document and start of every window under a batch of contexts."""
    data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), dtype=np.uint8)
    sizes = np.array([len(b.as_buffer()) for b in batch.column("bytes")], dtype=np.int64)
    counts = np.maximum(sizes - threshold + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.cumsum(sizes) - sizes)[row] + step
    out = np.empty(len(row), dtype=WINDOW)
    for name, family in (("a", 0), ("b", 1)):
        (hashes,) = window_hashes(data, (threshold,), family)
        out[name] = hashes[place].view(np.int64)
    out["doc"], out["tie"], out["start"] = np.asarray(batch.column("doc"))[row], np.asarray(batch.column("tie"))[row], np.asarray(batch.column("start"))[row] + step
    return out


def _repeats(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by digest and place, each place once, and which of them are not the first of their digest."""
    w = windows[np.lexsort((windows["start"], windows["tie"], windows["doc"], windows["b"], windows["a"]))]
    if len(w):
        w = w[np.concatenate([[True], w[1:] != w[:-1]])]
    return w, np.concatenate([[False], (w["a"][1:] == w["a"][:-1]) & (w["b"][1:] == w["b"][:-1])]) if len(w) else np.empty(0, bool)


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows as runs (doc, tie, span) of neighbouring starts."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.empty(0, bool)
    # A run is cut where its count would not fit the packing.
    at = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.empty(0, np.int64)
    first = np.flatnonzero(new | (at % 255 == 0))
    counts = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tie[first]), pa.array(start[first] << 8 | counts)], names=["doc", "tie", "span"])


def third_digits(open_rows: DataFrame, threshold: int) -> DataFrame:
    """(doc, tie, span) of repeated windows, where a first digit has few different rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            w, again = _repeats(_windows(table.to_batches()[0], threshold))
            return _spans(w["doc"][again], w["tie"][again], w["start"][again])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if last and sum(h.num_rows for h in held) + last:
                yield flush([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held and sum(h.num_rows for h in held):
            yield flush(held)

    return open_rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def dealt_windows(open_rows: DataFrame, threshold: int) -> DataFrame:
    """(doc, tie, span) of repeated windows, where a first digit has many different rows.

    A task settles what repeats inside it and sends on only the first of each window.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5_000):
                w, again = _repeats(_windows(batch.slice(a, 5_000), threshold))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[c])) for c in WINDOW.names), pa.array(again)], names=[*WINDOW.names, "again"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, doc, tie, start = (np.asarray(batch.column(c)) for c in WINDOW.names)
            first = last is not None and (x[0], y[0]) == last[:2] and (doc[0], tie[0], start[0]) != last[2:]
            other = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1])
            again = np.concatenate([[first], (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & other]) | np.asarray(batch.column("again").to_numpy(zero_copy_only=False))
            last = (x[-1], y[-1], doc[-1], tie[-1], start[-1])
            yield _spans(doc[again], tie[again], start[again])

    rows = open_rows.mapInArrow(emit, "a long, b long, doc long, tie long, start long, again boolean")
    # What is settled already needs no meeting: its own place serves as key.
    dealt = rows.withColumn("k", F.when(F.col("again"), F.xxhash64("doc", "tie", "start")).otherwise(F.xxhash64("a", "b")))
    return dealt.repartition("k").sortWithinPartitions("a", "b", "doc", "tie", "start").mapInArrow(settle, SPANS)


def text_tie(text_col: str) -> Column:
    """What tells documents of one id apart, and orders them."""
    return F.xxhash64(text_or_empty(text_col))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("i"), text_tie(text_col).alias("tie"), text_or_empty(text_col).alias("t"))


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, tie, spans) of documents with windows that also start earlier; a span is start * 256 + count."""
    if not DIGIT <= threshold <= DIGIT + 254:
        raise ValueError(f"the threshold must be from {DIGIT} to {DIGIT + 254} bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts_of(docs, id_col, text_col)
    seen = written(second_digits(first_digits(texts, threshold, parts), parts), "digits")
    open_rows = contexts(texts, seen.where("key is not null"), threshold)
    few = third_digits(open_rows.where("not many").drop("many"), threshold)
    many = dealt_windows(contexts(texts, seen.where("key is not null and many"), threshold).drop("many"), threshold)
    found = seen.where("key is null").select("doc", "tie", "span").unionByName(few).unionByName(many)
    return found.groupBy(F.col("doc").alias("i"), "tie").agg(F.collect_set("span").alias("spans"))


def kept_bytes(data: bytes, spans: list[int] | None, threshold: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes that are left."""
    if not spans:
        return [], data
    x = np.sort(np.array(spans, dtype=np.int64))
    start, end = x >> 8, (x >> 8) + (x & 255) - 1 + threshold
    # A run goes on while the next start is no later than the furthest end so far.
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    runs = list(zip(start[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist(), strict=True))
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return runs, b"".join([*left, data[at:]])


def dedup_report(docs: DataFrame, threshold: int = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, of every document."""
    joined = texts_of(docs, id_col, text_col).join(repeated_windows(docs, threshold, id_col=id_col, text_col=text_col), ["i", "tie"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, spans in zip(batch.column("i").to_pylist(), batch.column("t"), batch.column("spans").to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                runs, left = kept_bytes(data, spans, threshold)
                out.append((None if i == NULL_ID else i, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("i", "t", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(text: Column, spans: Column, threshold: int = THRESHOLD) -> Column:
    """A text without its removed runs; bytes of a character that is cut are dropped with it."""

    @F.udf("string", useArrow=True)
    def cut(t: str | None, s: list[int] | None) -> str | None:
        return None if t is None else kept_bytes(t.encode(), s, threshold)[1].decode(errors="ignore")

    return F.when(spans.isNull(), text).otherwise(cut(text, spans))


def drop_repeats(docs: DataFrame, threshold: int = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shortened texts and its other columns as they were.

    Every row stays; rows that repeat both id and text stay alike, each with what the first of its passages keeps.
    """
    spans = repeated_windows(docs, threshold, id_col=id_col, text_col=text_col).select(F.col("i").alias("_repeat_id"), F.col("tie").alias("_repeat_tie"), F.col("spans").alias("_repeat_spans"))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == spans["_repeat_id"]) & (text_tie(text_col) == spans["_repeat_tie"])
    joined = docs.join(spans, same, "left")
    return joined.select(*(without_repeats(F.col(c), F.col("_repeat_spans"), threshold).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
