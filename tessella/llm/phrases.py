"""Phrase collocation mining by vertical positional inverted lists (operator 11).

Texts are cut into blocks of words in the order of a scan, and a block keeps its
words vertically: a list of the positions of each word, all lists in one order of
positions, with a gap where a piece of text ends.  A level works on every block by
itself: the lists of phrases of k words are merge-joined, one place on, with the
lists of the words that end such phrases, which gives the lists of phrases of k + 1
words (both ends of a frequent phrase are frequent).  The length of a list is the
phrase's exact count in the block.  Only the lists of words are stored: a level makes
those of longer phrases again from them and the numbers below, which takes less
disk than lists of pairs, most of which are not frequent.

Spark deals these counts by a hash of the phrase into shares, one row a block and
share, whatever its phrases; a task adds up a share, gives the frequent phrases
numbers, and sends each block the numbers of its own.  The lists of other phrases
end there.  So no frequent set is ever sent to all tasks, a phrase that every block
has costs one entry a block, and no task holds more than a block or a share.

A phrase's number stands for its language too, as words of different languages
are different words.  What is left is relational: every cut of a candidate looks up
its two parts, every longer candidate looks for the shorter ones inside it, and
the best of each language are found in two steps, so that one language may hold
any share of the rows.

Edge cases: null and empty texts have no words; a null language is ``und``;
repeated rows count again; ids are not read, nor are other columns; ties of the
score go to the more frequent, then to the first phrase in byte order; an empty
table gives no rows; long texts are cut at ends of pieces into parts of about
``PART`` bytes, and a longer piece is one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._shared import dropped, mix64, shuffles_removed, text_or_empty, written

LEAST, LONGEST, BEST, PERCENT = 30, 4, 2_000, 80
SCALE = 2_000_000
#: Words of a block (the more, the fewer counts leave it; a task needs some 40 bytes for each), and bytes of a part of a text.
BLOCK, PART = 6 << 20, 1 << 23
#: Shares of the phrases for each shuffle partition, so that tasks get several and much the same.
SHARES = 4
#: First step of the ranking: parts of a language.
RANKED = 16
#: Ends of pieces become line feeds and tabs become spaces.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_SPACE, _END = -2, -1
ZSTD = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
#: What goes from task to task is compressed harder than Spark would.
ZIP = pa.Codec("zstd", compression_level=6)
#: A block's lists (no share), or its counts in one share.
COUNTS = "block long, share int, data binary, lang string, names binary"
#: Rows of a share: what goes back to a block, or frequent phrases by their words or parts, with numbers and counts.
FOUND = "block long, share int, data binary, lang string, names array<string>, a array<long>, b array<long>, ids array<long>, f array<long>, total long"


class _Numbers(dict):
    """Numbers of one language's words in a block; ``new`` counts those of all languages."""

    def __init__(self, new: Iterator[int]) -> None:
        super().__init__({b"": _SPACE, b"\n": _END})
        self.new = new

    def __missing__(self, word: bytes) -> int:
        number = self[word] = next(self.new)
        return number


def parts(text: str) -> Iterator[bytes]:
    """A text in lower case, with marked ends of pieces, cut there where it is long."""
    data, start = text.encode().lower().translate(_ENDS), 0
    while len(data) - start > PART and (cut := data.find(b"\n", start + PART)) >= 0:
        yield data[start:cut]
        start = cut
    yield data[start:]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers in one value: bytes of the same weight go together, as most of the high ones are zero, and are compressed."""
    raw = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return np.array([len(x) for x in raw], "<i8").tobytes() + ZIP.compress(b"".join(raw), asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", count=len(kinds)).tolist()
    raw, at, out = pa.decompress(memoryview(data)[8 * len(kinds) :], sum(sizes), "zstd", asbytes=True), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, count=size, offset=at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def packed_names(names: list[bytes]) -> bytes:
    """Words in one value; a line feed is in none of them."""
    raw = b"\n".join(names)
    return np.array([len(raw)], "<i8").tobytes() + ZIP.compress(raw, asbytes=True)


def unpacked_names(data: bytes) -> list[bytes]:
    size = int(np.frombuffer(data, "<i8", count=1)[0])
    return pa.decompress(memoryview(data)[8:], size, "zstd", asbytes=True).split(b"\n")


def _gaps(places: np.ndarray) -> np.ndarray:
    """Ascending positions as gaps, which compress well."""
    return np.diff(places, prepend=0).astype("<i4")


def _row(schema: str, **values: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(name)], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def word_lists(docs: DataFrame, text_col: str, lang_col: str, block: int, shares: int) -> DataFrame:
    """Rows of blocks (``COUNTS``): the positions of their words; and their words' names and counts by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import count
        from zlib import crc32

        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId() << 32, 0
        known: dict[str, _Numbers] = {}
        new, held, size = count(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            every = every[every != _SPACE]
            places = np.flatnonzero(every >= 0)
            own = every[places]
            if not len(own):
                return
            n = np.bincount(own)
            yield _row(COUNTS, block=task + made, data=packed(_gaps(places), own.astype("<i4")))
            for lang, words in known.items():
                names, numbers = list(words)[2:], np.fromiter(list(words.values())[2:], np.int32)
                of = np.fromiter(map(crc32, names), np.int64, count=len(names)) % shares
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shares + 1)).tolist()
                for share, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if b > a:
                        mine = numbers[order[a:b]]  # ascending, as words are numbered in the order they are kept in
                        yield _row(COUNTS, block=task + made, share=share, lang=lang, names=packed_names([names[i] for i in order[a:b].tolist()]), data=packed(_gaps(mine), n[mine].astype("<i8")))

        for batch in batches:
            for text, lang in zip(batch.column("t"), batch.column("lang").to_pylist(), strict=True):
                for data in parts(text.as_py()):
                    if lang not in known:
                        known[lang] = _Numbers(new)
                    tokens = data.replace(b"\n", b" \n ").split(b" ")
                    held.append(np.fromiter(map(known[lang].__getitem__, tokens), np.int32, count=len(tokens)))
                    held.append(np.array([_END], np.int32))
                    size += len(tokens)
                    if size >= block:
                        yield from flush()
                        known, new, held, size, made = {}, count(), [], 0, made + 1
        if held:
            yield from flush()

    rows = docs.select(text_or_empty(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, COUNTS)


def _sums(groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact sums of n by group number, from 0."""
    order = np.argsort(groups, kind="stable")
    return np.add.reduceat(n[order], np.searchsorted(groups[order], np.arange(groups.max() + 1)))


def added_up(counts: DataFrame, least: int, first: bool) -> DataFrame:
    """Shares (``FOUND``) of ``COUNTS``: frequent phrases with numbers, and what each block gets back; of words (``first``) also each language's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, base, held = None, 0, []

        def finish() -> Iterator[pa.RecordBatch]:
            """Of one share, and with words of one language."""
            nonlocal base
            if not held:
                return
            lang = held[0]["lang"]
            if first:
                split = [unpacked(r["data"], "<i4", "<i8") for r in held]
                encoded = pa.concat_arrays([pa.array(unpacked_names(r["names"]), pa.binary()) for r in held]).dictionary_encode()
                n, group = np.concatenate([x[1] for x in split]), encoded.indices.to_numpy()
            else:
                split = [unpacked(r["data"], "<i8", "<i8", "<i8") for r in held]
                a, b, n = (np.concatenate([x[c] for x in split]) for c in (0, 1, 2))
                order = np.lexsort((b, a))
                new = np.ones(len(a), dtype=bool)
                new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
                group = np.empty(len(a), dtype=np.int64)
                group[order] = np.cumsum(new) - 1
            f = _sums(group, n)
            kept = np.flatnonzero(f >= least)
            number = np.full(len(f), -1, dtype=np.int64)
            number[kept] = base + np.arange(len(kept))
            if first:
                yield _row(FOUND, lang=lang, total=int(n.sum()))
            if len(kept):
                ids = (np.int64(share) << 32) + number[kept]
                if first:
                    yield _row(FOUND, lang=lang, names=encoded.dictionary.take(pa.array(kept)).cast(pa.string()), ids=ids, f=f[kept])
                else:
                    firsts = order[new][kept]
                    yield _row(FOUND, a=a[firsts], b=b[firsts], ids=ids, f=f[kept])
                at = 0
                for r, x in zip(held, split, strict=True):
                    mine = number[group[at : at + len(x[0])]]
                    at += len(x[0])
                    if (mine >= 0).any():
                        # A word by its number in the block, a phrase by its place in this row, which the block makes again.
                        own = np.cumsum(x[0], dtype=np.int64)[mine >= 0] if first else np.flatnonzero(mine >= 0)
                        yield _row(FOUND, block=r["block"], share=share, data=packed(_gaps(own), mine[mine >= 0].astype("<i4")))
            base += len(kept)

        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("block", "share", "lang", "data", "names")}
                if held and (row["share"], row["lang"]) != (share, held[0]["lang"]):
                    yield from finish()
                    held = []
                if row["share"] != share:
                    share, base = row["share"], 0
                held.append(row)
        yield from finish()

    dealt = counts.where("share IS NOT NULL").repartition("share").sortWithinPartitions("share", "lang")
    return dealt.mapInArrow(run, FOUND)


def extended(places: np.ndarray, phrases: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of phrases of k words merged with those of the words that come next: positions, phrases and last words.

    ``words`` holds each occurrence's last word, so its postings are the places k - 1 further on.
    """
    postings, wanted = places + (k - 1), places + k
    at = np.searchsorted(postings, wanted)
    met = at < len(postings)
    met[met] = postings[at[met]] == wanted[met]
    return places[met], phrases[met], words[at[met]]


def longer(lists: DataFrame, found: list[DataFrame], shares: int) -> DataFrame:
    """Counts by share (``COUNTS``) of phrases of k + 1 words, from the lists of words and the numbers of frequent phrases of 1, ..., k words (``found``)."""
    ordered = lists.where("share IS NULL").select("block", F.lit(0).alias("k"), "share", "data")
    for k, own in enumerate(found, 1):
        ordered = ordered.union(own.where("block IS NOT NULL").select("block", F.lit(k).alias("k"), "share", "data"))
    ordered, levels = ordered.repartition("block").sortWithinPartitions("block", "k", "share"), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, backs = None, b"", []

        def finish() -> Iterator[pa.RecordBatch]:
            if not backs or not all(backs):
                return
            gaps, words = unpacked(held, "<i4", "<i4")
            places, phrases, names = np.cumsum(gaps, dtype=np.int64), words, None
            for k, back in enumerate(backs, 1):
                number = np.full(int(phrases.max()) + 1, -1, dtype=np.int64)
                for share, data in back:
                    own, mine = unpacked(data, "<i4", "<i4")
                    own = np.cumsum(own, dtype=np.int64)
                    number[own if k == 1 else order[cuts[share] + own]] = (np.int64(share) << 32) + mine
                if k == 1:
                    names = number
                kept = number[phrases] >= 0
                places, phrases, words = extended(places[kept], phrases[kept], words[kept], k)
                if not len(places):
                    return
                keys, phrases, n = np.unique(phrases.astype(np.int64) * len(names) + words, return_inverse=True, return_counts=True)
                a, b = number[keys // len(names)], names[keys % len(names)]
                of = (mix64(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shares + 1)).tolist()
            for share, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if end > start:
                    own = order[start:end]
                    yield _row(COUNTS, block=block, share=share, data=packed(a[own], b[own], n[own].astype("<i8")))

        for batch in batches:
            for own, k, share, data in zip(*(batch.column(c).to_pylist() for c in ("block", "k", "share", "data")), strict=True):
                if k == 0:
                    yield from finish()
                    block, held, backs = own, data, [[] for _ in range(levels)]
                else:
                    backs[k - 1].append((share, data))
        yield from finish()

    return ordered.mapInArrow(run, COUNTS)


def frequent_phrases(docs: DataFrame, least: int, longest: int, block: int, *, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words with ``least`` occurrences; and (lang, n), the words of each language."""
    spark = docs.sparkSession
    shares = SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        lists = written(word_lists(docs, text_col, lang_col, block, shares), "phrase-lists", **ZSTD)
        found = [written(added_up(lists, least, True), "phrases-1", **ZSTD)]
        totals = found[0].where("total IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n"))
        words = found[0].where("names IS NOT NULL").select("lang", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("names").alias("phrase"), "f")))
        every = [words.select("id", "lang", "phrase", F.lit(1).alias("k"), "f")]
        for k in range(1, longest):
            found.append(written(added_up(longer(lists, found, shares), least, False), f"phrases-{k + 1}", **ZSTD))
            counts = found[k].where("a IS NOT NULL").select(F.inline(F.arrays_zip("a", "b", F.col("ids").alias("id"), "f")))
            start, last = every[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("start")), words.select(F.col("id").alias("b"), F.col("phrase").alias("last"))
            named = counts.join(start, "a").join(last, "b").select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), F.lit(k + 1).alias("k"), "f")
            every.append(written(named, f"phrases-named-{k + 1}"))
        dropped(lists, *found[1:])
    out = every[0].select("lang", "phrase", "k", "f")
    for own in every[1:]:
        out = out.union(own.select("lang", "phrase", "k", "f"))
    return out, totals


def _joined(words: Column, start: int, count: int) -> Column:
    return F.array_join(F.slice(words, start, count), " ")


def _cuts(words: Column, longest: int) -> Column:
    """Where a phrase can be cut: after how many words, the first part and the rest."""
    cut = [F.when(F.size(words) > i, F.struct(F.lit(i).alias("cut"), _joined(words, 1, i).alias("start"), F.array_join(F.slice(words, F.lit(i + 1), F.size(words) - i), " ").alias("rest"))) for i in range(1, longest)]
    return F.filter(F.array(*cut), lambda c: c.isNotNull())


def _inside(words: Column, longest: int) -> Column:
    """Shorter phrases of two or more words inside a phrase."""
    spans = [(start, size) for size in range(2, longest) for start in range(1, longest - size + 2)]
    return F.array_distinct(F.filter(F.array(*(F.when((F.size(words) > size) & (F.size(words) >= start + size - 1), _joined(words, start, size)) for start, size in spans)), lambda s: s.isNotNull()))


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, percent: int = PERCENT, *, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two to ``longest`` words by the lowest-scoring cut."""
    every, totals = frequent_phrases(docs, least, longest, block, text_col=text_col, lang_col=lang_col)
    words = F.split("phrase", " ")
    long = every.where(F.col("k") > 1)
    covers = every.where(F.col("k") > 2).select("lang", "f", F.explode(_inside(words, longest)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    covered = F.coalesce(F.lit(100).cast("decimal(3,0)") * _exact(F.col("cover")) >= F.lit(percent).cast("decimal(3,0)") * _exact(F.col("a")), F.lit(False))
    kept = long.select("lang", "phrase", F.col("f").alias("a")).join(covers, ["lang", "phrase"], "left").where(~covered).drop("cover")
    cut = kept.select("lang", "phrase", "a", F.inline(_cuts(words, longest)))
    cut = cut.join(every.select("lang", F.col("phrase").alias("start"), F.col("f").alias("l")), ["lang", "start"]).join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS LONG)")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = W.partitionBy("lang", "part").orderBy(*order)
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= best).drop("part")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, d, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT lang, d, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS p FROM lowered)
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), counted AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f FROM placed, range(1, {LONGEST + 1}) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= {LEAST}
), inside AS (
  SELECT lang, f, array_to_string(w[s : s + size - 1], ' ') AS phrase FROM candidates, range(1, {LONGEST}) AS a(s), range(2, {LONGEST}) AS b(size) WHERE size < k AND s + size - 1 <= k
), covers AS (
  SELECT lang, phrase, max(f) AS cover FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covers v ON v.lang = c.lang AND v.phrase = c.phrase WHERE v.cover IS NULL OR 100 * CAST(v.cover AS HUGEINT) < {PERCENT} * CAST(c.f AS HUGEINT)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, CAST({SCALE} * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM kept c JOIN range(1, {LONGEST}) AS x(cut) ON cut < c.k
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE o = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {BEST}"""
