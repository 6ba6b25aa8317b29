"""Texts and pages cut into units of bounded size: one row in, n rows out.

Packing is a fold over one text's paragraphs, never over a table; the text is
split into (piece, words, separator) first, so the fold only compares numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import SPACE, once, sentences, trim_all, word_count
from tessella.operators import scan


def _units(pieces: Column) -> Column:
    return F.transform(pieces, lambda s: F.struct(s.alias("s"), word_count(s).alias("w")))


def pack(units: Column, most: int, separator: str) -> Column:
    """Greedy chunks of units (s, w) in order: a chunk closes before the unit that would take it over ``most`` words."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("w"))

    def step(acc: Column, u: Column) -> Column:
        closes = (acc["open"] != "") & (acc["w"] + u["w"] > most)
        return F.when(closes, F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), u["s"].alias("open"), u["w"].alias("w"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["open"] == "", u["s"]).otherwise(F.concat(acc["open"], F.lit(separator), u["s"])).alias("open"), (acc["w"] + u["w"]).alias("w"))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(units, start, step, finish)


def chunk_paragraphs(text: Column, most: int = 2500, separator: str = r"\n{2,}", variant: str = "job") -> Column:
    """Array of chunks.  Paragraphs are packed up to ``most`` words; a longer one stands alone and is split at sentences.

    ``variant`` "job" parts sentences at white space after their end and joins
    them by one space; "batch" keeps each sentence's own ending, quote and
    space, and knows the Urdu full stop; "whole" leaves a longer paragraph as it is.
    """
    source = F.coalesce(text, F.lit(""))
    if variant == "batch":
        source = F.replace(source, F.lit("\r\n"), F.lit("\n"))
    paragraphs = _units(F.filter(F.transform(F.split(source, separator), trim_all), lambda p: p != ""))

    def long_ones(p: Column) -> Column:
        if variant == "whole":
            return F.array(p["s"])
        if variant == "batch":
            ends = r"[^.!?۔。！？]+[.!?۔。！？]+[\"'»」』]?" + SPACE + r"*|[^.!?۔。！？]+$"
            return F.filter(F.transform(pack(_units(F.regexp_extract_all(p["s"], F.lit(ends), F.lit(0))), most, ""), trim_all), lambda c: c != "")
        return pack(_units(sentences(p["s"])), most, " ")

    # The fold over word counts says at which paragraphs chunks begin; a long one closes what is open and is closed by the next.
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(0).alias("w"))

    def step(acc: Column, u: Column) -> Column:
        begins = (acc["i"] == 0) | (acc["w"] + u["w"] > most)
        return F.struct(F.when(begins, F.array_append(acc["at"], acc["i"])).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), F.when(begins, u["w"]).otherwise(acc["w"] + u["w"]).alias("w"))

    def cut(units: Column) -> Column:
        def one(at: Column, first: Column, k: Column) -> Column:
            own = F.slice(units, first + 1, F.coalesce(F.get(at, k + 1), F.size(units)) - first)
            return once(own, lambda g: F.when(g[0]["w"] > most, long_ones(g[0])).otherwise(F.array(F.array_join(F.transform(g, lambda u: u["s"]), "\n\n"))))

        return once(F.aggregate(units, start, step, lambda acc: acc["at"]), lambda at: F.flatten(F.transform(at, lambda first, k: one(at, first, k))))

    return once(paragraphs, cut)


def chunks(docs: DataFrame, most: int = 2500, separator: str = r"\n{2,}", variant: str = "job", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk, words) of every document."""
    out = docs.select(id_col, F.posexplode(chunk_paragraphs(F.col(text_col), most, separator, variant)).alias("chunk_index", "chunk"))
    return out.withColumn("words", word_count(F.col("chunk")))


def split_words(text: Column, most: int = 5000) -> Column:
    """Windows of ``most`` words; a window ends early at a sentence's end in its last 30 per cent."""
    words = F.split(text, rf"{SPACE}+")
    # Places after which a sentence ends, made once; the fold then only compares numbers.
    made = F.struct(words.alias("w"), F.filter(F.transform(words, lambda x, i: F.when(x.rlike(r"[.!?…]$"), i)), lambda i: i.isNotNull()).alias("ends"))

    def windows(m: Column) -> Column:
        n = F.size(m["w"])
        start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("at"))

        def step(acc: Column, _: Column) -> Column:
            end = F.least(acc["at"] + most, n)
            last = F.array_max(F.filter(m["ends"], lambda j: (j < end) & (j > acc["at"] + most * F.lit(0.7))))
            stop = F.when(end < n, F.coalesce(last + 1, end)).otherwise(end)
            return F.when(acc["at"] >= n, acc).otherwise(F.struct(F.array_append(acc["cuts"], stop).alias("cuts"), stop.alias("at")))

        # A window holds at least 70 per cent of its words, which bounds the steps.
        cuts = F.aggregate(F.sequence(F.lit(1), F.ceil(n / F.lit(max(1.0, most * 0.7))).cast("int") + 1), start, step)["cuts"]
        pairs = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.array_join(F.slice(m["w"], a + 1, b - a), " "))
        return F.when(n <= most, F.array(text)).otherwise(pairs)

    # An array of one keeps the words from being split again for each use.
    return F.transform(F.array(made), windows)[0]


def chunk_pages(words: Column, most: int = 2000) -> Column:
    """Ranges (first, last) of pages, from their word counts in order."""
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("w"))

    def step(acc: Column, n: Column) -> Column:
        closes = (acc["w"] + n > most) & (acc["at"] > acc["first"])
        return F.when(closes, F.struct(F.array_append(acc["done"], F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"))).alias("done"), acc["at"].alias("first"), (acc["at"] + 1).alias("at"), n.alias("w"))).otherwise(
            F.struct(acc["done"].alias("done"), acc["first"].alias("first"), (acc["at"] + 1).alias("at"), (acc["w"] + n).alias("w"))
        )

    return F.aggregate(words, start, step, lambda acc: F.when(acc["first"] < acc["at"], F.array_append(acc["done"], F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last")))).otherwise(acc["done"]))


def ranges_of_pages(pages: DataFrame, most: int = 2000, width: int = scan.INDEXES) -> DataFrame:
    """(source, range_idx, first, last): ``chunk_pages`` over whole tables (source, page, words), by parallel scans over ``width`` page numbers each, so a source may have any number of pages.

    The fold's state is the number of words of the open range, and that is at most one more than ``most``.
    """
    bucket = scan.bucket_of(F.col("page"), width)

    def add(states: np.ndarray, n: int) -> np.ndarray:
        # 0: no page yet; 1 + words of the open range.
        closes = (states == 0) | (states - 1 + n > most)
        return np.minimum(np.where(closes, n, states - 1 + n), most + 1) + 1

    own = pages.select("source", "page", F.least("words", F.lit(most + 1)).cast("long").alias("words"))
    packed = scan.folded(own, ["source"], bucket, ["page"], "words", most + 3, add)
    opens = ((F.col("before") == 0) | (F.col("before") - 1 + F.col("words") > most)).cast("long")
    ranged = scan.running(packed, ["source"], bucket, ["page"], range_idx=opens)
    return ranged.groupBy("source", (F.col("range_idx") - 1).cast("int").alias("range_idx")).agg(F.min("page").alias("first"), F.max("page").alias("last"))


def plan_batches(pages: Column, size: int = 50) -> Column:
    """Ranges (first, last) of ``size`` pages, from 1."""
    return F.when(pages < 1, F.array().cast("array<struct<first:int,last:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(pages, F.lit(1)).cast("int"), F.lit(size)), lambda a: F.struct(a.alias("first"), F.least(a + size - 1, pages).cast("int").alias("last"))))


def shrink_batch(first: Column, last: Column, size: Column, least: int = 10) -> Column:
    """Halves of a failed range, of at least ``least`` pages; null where it cannot shrink and has failed."""
    half = F.greatest(F.lit(least), F.floor(size / 2)).cast("int")
    parts = F.transform(F.sequence(first, last, half), lambda a: F.struct(a.alias("first"), F.least(a + half - 1, last).cast("int").alias("last")))
    return F.when(size > least, parts)


def safe_pair_tokens(a: Column, b: Column, separator: int = 60, overhead: int = 800) -> Column:
    """Tokens of two texts in one request, with a fifth of headroom."""
    return F.ceil(F.ceil((a + F.lit(separator) + b + F.lit(overhead)) / 4) * 12 / 10)


def neighbour_pairs(jobs: DataFrame, most: int = 6000, width: int = scan.INDEXES) -> DataFrame:
    """Each claimable chunk with the next of its project and language, if that is claimable too, and whether both fit one request.

    Where there is a status, the pending ones are claimable.
    """
    open_ = jobs.where("status = 'pending'") if "status" in jobs.columns else jobs
    both = scan.neighbour(open_.select("project_id", "lang", "chunk_index", "n_chars"), ["project_id", "lang"], scan.bucket_of(F.col("chunk_index"), width), ["chunk_index"], {"next_index": "chunk_index", "next_chars": "n_chars"}, ahead=True)
    both = both.where(F.col("next_index") == F.col("chunk_index") + 1).withColumn("tokens", safe_pair_tokens(F.col("n_chars"), F.col("next_chars")))
    return both.withColumn("fits", F.col("tokens") <= most)


def backoff_ms(attempt: Column, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Doubling delays from 2 s to 120 s, no shorter than what the server asked for."""
    delay = F.least(F.lit(120_000), F.lit(2_000) * F.pow(F.lit(2), F.least(attempt, F.lit(16)))).cast("long") + (jitter if jitter is not None else F.lit(0))
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after, F.lit(0)))
