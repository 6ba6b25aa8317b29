"""Token ids in flat binary files (operator 8).

``write_token_files`` tokenises documents in ascending id order and writes, for
each range of ids, one flat file of unsigned integers and one file of 64-bit
document offsets.  A file's place in the whole stream is a prefix sum over the
files' token counts, so no task needs to know more than its own range.
``read_token_files`` memory-maps the files again.

Layout of one range, ``<stem>``:

* ``<stem>.bin``  little-endian ids, ``uint16`` where the vocabulary allows it,
  else ``uint32``;
* ``<stem>.idx``  little-endian ``int64``: the documents' ids, then their local
  start offsets, then the number of tokens.

Edge cases: a null or empty text is a document of the end id alone; a null
document id sorts first (kept as the smallest 64-bit integer); repeated ids stay together, ordered by text;
an empty table gives no files.  Only the two named columns are read, so other
columns may carry any name.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import by_bytes, fresh_path, spelled, text_or_empty, to_batch

#: Words whose ids a worker remembers before it forgets them all; bounds its memory.
CACHED_WORDS = 400_000
#: Bytes of texts whose different words are looked up together: time against memory.
TOGETHER = 8 << 20
#: Stands between words that are encoded together; its byte occurs in no other character.
SENTINEL = "\x01"
NULL_ID = -(1 << 63)
#: Latin letters that lower-casing maps one to one, then ASCII punctuation that begins no contraction.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-&(-/:-@\[-`{-~]*)")
#: A Latin letter in lower case as far as ASCII goes, and such punctuation after it: white space between them changes nothing.
JOINED = r"([a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}])([!-&(-/:-@\[-`{-~])"

FILES = T.StructType([
    T.StructField("stem", T.StringType()), T.StructField("first_id", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> "WordEncoder":
    return WordEncoder(path)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space.

    Such a tokenizer never looks across white space, so the ids of a text are
    those of its words; words repeat, and each is encoded once.  Words that hold
    the text of an added token, such as an end mark, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() or c == SENTINEL for text in added for c in text):
            raise ValueError("an added token holds white space or the separating character")
        # In any case: a tokenizer may look for them after it has dropped case.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        # Texts whose case and punctuation are left alone: with added tokens, marks that join letters, or a sigma, whose small form depends on its place.
        self.odd = "(?i:" + "|".join([*map(re.escape, added), SENTINEL]) + r")|\p{M}|\x{3a3}"
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.plain = PLAIN.fullmatch
        self.merges = self.tokenizer.model.tokenize
        self.bytewise = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        suffix = self.tokenizer.model.end_of_word_suffix
        #: By id: whether a word's last token; without such a mark words are encoded alone.
        self.last = np.array([bool(t) and t.endswith(suffix) for t in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))]) if suffix else None
        self.stop = self._ids(SENTINEL)
        if len(self.stop) != 1:
            raise ValueError("the tokenizer has no single id for the separating character")
        probe = ["a", "the", "straße", "ñandú", "éleveur", "antidisestablishment"]
        if any(self._stem(w) + self._ids("..").tobytes() != self._ids(f"{w.capitalize()}..").tobytes() for w in probe):
            raise ValueError("the tokenizer keeps case or joins letters with punctuation")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _stem(self, word: str) -> bytes:
        """Ids of lower-case letters, which no rule of the tokenizer parts, from its merges alone."""
        if not word.isascii():
            word = "".join(piece for piece, _ in self.bytewise(word))
        return np.array([t.id for t in self.merges(word)], dtype=self.dtype).tobytes()

    def _stems(self, words: list[str]) -> None:
        """Ids of different such words, of which each is one pre-token, parted by their last tokens."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            if self.last is None:
                self.known.update((word, self._stem(word)) for word in part)
                continue
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError("words and their last ids do not match")
            raw = ids.tobytes()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _encode(self, words: list[str]) -> None:
        """Encode words together, parted by the separating character."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            (found,) = self.tokenizer.encode_batch_fast([f" {SENTINEL} ".join([*part, ""])], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.stop[0])
            if len(ends) != len(part):
                raise ValueError("words and separators do not match")
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for word, end in zip(part, (ends * size).tolist(), strict=True):
                self.known[word] = raw[start:end]
                start = end + size

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of new words.

        Case is dropped and letters never join punctuation, so a word of plain
        letters with punctuation after it has the ids of its two parts.
        """
        known, whole, plain = self.known, set(), []
        for word in words:
            found = self.plain(word)
            if SENTINEL in word or self.added(word):
                known[word] = self._ids(word).tobytes()
            elif found:
                tail = found[2]
                plain.append((word, found[1].lower(), tail))
                if tail not in known:
                    whole.add(tail)
            else:
                whole.add(word)
        self._encode(list(whole))
        self._stems(list({stem for _, stem, _ in plain if stem not in known}))
        for word, stem, tail in plain:
            if tail or word != stem:
                known[word] = known[stem] + known[tail]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        out = []
        for own in by_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), TOGETHER):
            odd = pc.match_substring_regex(own, self.odd)
            others, plain = iter(self._by_text(own.filter(odd).to_pylist())), iter(self._together(own.filter(pc.invert(odd))))
            out += [next(others) if x else next(plain).tobytes() for x in odd.to_pylist()]
        return out

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts by their different words, letters and punctuation apart."""

        def ids_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            if len(self.known) > CACHED_WORDS:
                self.known = {"": b""}
            every = words.to_pylist()
            self._learn([w for w in every if w not in self.known])
            made = list(map(self.known.__getitem__, every))
            return np.frombuffer(b"".join(made), dtype=self.dtype), np.fromiter(map(len, made), np.int64, count=len(made)) // self.dtype.itemsize

        apart = pc.replace_substring_regex(pc.ascii_lower(texts), JOINED, r"\1 \2")
        for space in "\n\t\r":
            apart = pc.replace_substring(apart, space, " ")
        return spelled(pc.split_pattern(apart, " "), ids_of)

    def _by_text(self, texts: list[str]) -> list[bytes]:
        # Only ASCII white space is a boundary here; the tokenizer sees to the rest.
        out, size = [], 2_000
        for i in range(0, len(texts), size):
            split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts[i : i + size]]
            if len(self.known) > CACHED_WORDS:
                self.known = {"": b""}
            fresh = set().union(*split).difference(self.known)
            if fresh:
                self._learn(fresh)
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out


def _save(uri: str, *parts: bytes) -> None:
    """Write under another name, then rename: a task that is run again leaves no half file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path + ".part") as f:
        for part in parts:
            f.write(part)
    fs.move(path + ".part", path)


def _mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(
    docs: DataFrame, tokenizer: str, *, end_id: int = 1, path: str | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the files; returns one row a range: stem, first_id, n_docs, n_tokens, base.

    ``base`` is the number of ids in all earlier ranges.  The rows pass through
    the driver; there are as many as partitions, whatever the data.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("i"), text_or_empty(text_col).alias("t"))
        .repartitionByRange(n, "i").sortWithinPartitions("i", "t")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        stem, ids, sizes, size, out = f"{path}/{uuid.uuid4().hex}", [], [], coder.dtype.itemsize, None
        fs, local = pafs.FileSystem.from_uri(path)
        for batch in batches:
            if out is None:
                fs.create_dir(local, recursive=True)
                out = fs.open_output_stream(f"{local}/{os.path.basename(stem)}.bin")
            ids.append(np.asarray(batch.column("i")))
            for code in coder.encode(batch.column("t")):
                out.write(code + end)
                sizes.append(len(code) // size + 1)
        if out is None:
            return
        out.close()
        every = np.concatenate(ids).astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype="<i8")]).astype("<i8")
        _save(f"{stem}.idx", every.tobytes(), offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"stem": [stem], "first_id": [int(every[0])], "n_docs": [len(every)], "n_tokens": [int(offsets[-1])]})

    rows = sorted(ordered.mapInArrow(write, FILES).collect(), key=lambda r: r.first_id)
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows], dtype=np.int64)])
    schema = T.StructType([*FILES.fields, T.StructField("base", T.LongType()), T.StructField("wide", T.BooleanType())])
    wide = word_encoder(tokenizer).dtype.itemsize > 2
    return spark.createDataFrame([(*r, int(b), wide) for r, b in zip(rows, bases, strict=False)], schema)


def read_token_files(files: DataFrame, columns: str, per_document: Callable[[np.ndarray], tuple]) -> DataFrame:
    """One row a document: doc_id, start, n_tokens and what ``per_document`` makes of its ids.

    ``columns`` is the DDL of the added columns.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens")] + T.StructType.fromDDL(columns).fields)
    names = schema.names[3:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(f"{row['stem']}.bin", np.dtype("<u4" if row["wide"] else "<u2"))
                index = _mapped(f"{row['stem']}.idx", np.dtype("<i8"))
                own, offsets = index[: row["n_docs"]], index[row["n_docs"] :]
                for a in range(0, len(own), 5_000):
                    b = min(a + 5_000, len(own))
                    made = [per_document(ids[offsets[k] : offsets[k + 1]]) for k in range(a, b)]
                    out = {"doc_id": [None if x == NULL_ID else x for x in own[a:b].tolist()], "start": offsets[a:b] + row["base"], "n_tokens": np.diff(offsets[a : b + 1])}
                    yield to_batch(arrow, out | {name: [m[k] for m in made] for k, name in enumerate(names)})

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(spread, "stem").mapInArrow(read, schema)


def crc_of_ids(ids: np.ndarray) -> tuple:
    return (zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()),)


def token_file_report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, tokenizer, **options), "ids_crc32 long", crc_of_ids)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
