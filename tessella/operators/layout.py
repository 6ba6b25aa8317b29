"""Positioned page items as lines, blocks, pages and fitted text.

Lines group by window functions; what depends on a block's first line, or on
earlier decisions, is a fold over one page.  Greater units than a page are
never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import round_half_up, trim_all, word_count
from tessella.operators import scan

LINE = "doc_id, page"


def merge_lines(items: DataFrame) -> DataFrame:
    """Lines of each page: items whose baselines lie within 2 of the one before, joined left to right by their gaps.

    ``items`` has doc_id, page, item_idx, str, x, y, width, height.
    """
    page = W.partitionBy("doc_id", "page")
    down = page.orderBy(F.desc("y"), "item_idx")
    usable = items.where(trim_all(F.col("str")) != "").withColumn("new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(down)) > 2).cast("int"), F.lit(0)))
    grouped = usable.withColumn("g", F.sum("new").over(down.rowsBetween(W.unboundedPreceding, 0)))
    height = lambda i: F.when(i["height"] > 0, i["height"]).otherwise(10.0)
    own = F.array_sort(F.collect_list(F.struct("x", "item_idx", "str", "y", "width", "height")))
    lines = grouped.groupBy("doc_id", "page", "g").agg(own.alias("i"))
    start = F.struct(F.lit("").alias("t"), F.lit(0.0).cast("double").alias("right"))

    def join(acc: Column, i: Column) -> Column:
        spaced = acc["t"].rlike(r"[ \t\n]$") | i["str"].rlike(r"^[ \t\n]")
        joiner = F.when(spaced, " ").when(i["x"] - acc["right"] < 0.3 * F.greatest(i["height"], F.lit(1.0)), "").otherwise(" ")
        text = F.when(acc["t"] == "", i["str"]).otherwise(F.concat(F.rtrim(acc["t"]), joiner, F.ltrim(i["str"])))
        return F.struct(text.alias("t"), F.greatest(acc["right"], i["x"] + i["width"]).alias("right"))

    made = lines.withColumn("f", F.aggregate("i", start, join)).select(
        "doc_id", "page", "g", trim_all(F.regexp_replace("f.t", " {2,}", " ")).alias("text"), F.col("i")[0]["x"].alias("x"), F.array_max("i.y").alias("y"),
        (F.col("f.right") - F.col("i")[0]["x"]).alias("width"), F.array_max(F.transform("i", height)).alias("height"), (F.aggregate(F.transform("i", height), F.lit(0.0), lambda a, b: a + b) / F.size("i")).alias("font_size"),
    ).where("text <> ''")
    # A line that ends in a hyphen takes the next one in, as often as that repeats.
    order = page.orderBy("g")
    carried = made.withColumn("new", F.coalesce((~(F.lag("text").over(order).rlike("[a-z]-$") & F.col("text").rlike("^[a-z]"))).cast("int"), F.lit(0)))
    run = carried.withColumn("r", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "page", "r").agg(F.array_sort(F.collect_list(F.struct("g", "text", "x", "y", "width", "height", "font_size"))).alias("l"))
    first = F.col("l")[0]
    text = F.aggregate("l", F.lit(""), lambda acc, x: F.concat(F.regexp_replace(acc, "-$", ""), x["text"]))
    only = F.when(F.size("l") == 1, first["text"]).otherwise(text)
    right = F.array_max(F.transform("l", lambda x: x["x"] + x["width"] - first["x"]))
    return run.select("doc_id", "page", F.col("r").cast("int").alias("line_idx"), only.alias("text"), first["x"].alias("x"), first["y"].alias("y"), right.alias("width"), first["height"].alias("height"), F.array_max("l.font_size").alias("font_size"))


def modal_gaps(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_gap): mean of the fullest 2-point bucket of gaps; ties go to the bucket whose first gap is smaller."""
    order = W.partitionBy("doc_id", "page").orderBy("line_idx")
    gaps = lines.withColumn("gap", F.lag("y").over(order) - F.col("y")).where("gap > 0.5 and gap < 200").withColumn("bucket", round_half_up(F.col("gap") / 2))
    buckets = gaps.groupBy("doc_id", "page", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("gap", "line_idx").alias("first"), F.avg("gap").alias("mean"))
    return buckets.groupBy("doc_id", "page").agg(F.max_by("mean", F.struct("n", -F.col("first"), -F.col("bucket"))).alias("line_gap"))


BLOCK = "doc_id long, page int, block_idx int, text string, x double, y double, width double, height double, font_size double, line_count int, align string"


def cluster_blocks(lines: DataFrame) -> DataFrame:
    """Paragraph blocks of each page, top first; a break needs the block's first line, so a page's lines are folded in order, from a sorted stream."""
    ready = lines.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "line_idx")

    def modal_gap(rows: list) -> float:
        """What ``modal_gaps`` gives for the page, or 0."""
        buckets: dict[int, list[float]] = {}
        for above, below in zip(rows, rows[1:], strict=False):
            if 0.5 < (gap := above.y - below.y) < 200:
                buckets.setdefault(floor(gap / 2 + 0.5), []).append(gap)
        best = max(buckets.items(), key=lambda b: (len(b[1]), -b[1][0], -b[0]), default=(0, [0.0]))[1]
        return sum(best) / len(best)

    def fold(rows: list) -> list[tuple]:
        gap = modal_gap(rows)
        blocks, held = [], []

        def flush() -> None:
            left, right = min(r.x for r in held), max(r.x + r.width for r in held)
            top, bottom, size = max(r.y for r in held), min(r.y - r.height for r in held), max(r.font_size for r in held)
            center = sum(r.x + r.width / 2 for r in held) / len(held)
            centered = len(held) > 1 and all(abs(r.x + r.width / 2 - center) <= 3 for r in held) and left - (center - (right - left) / 2) > 4
            blocks.append(("\n".join(r.text for r in held), left, top, max(right - left, 1.0), max(top - bottom, size), size, len(held), "center" if centered else "left"))

        for r in rows:
            if held:
                far = gap > 0 and held[-1].y - r.y > 1.5 * gap
                if far or abs(r.x - held[0].x) > 2 or abs(r.font_size - held[-1].font_size) / max(held[-1].font_size, 1) > 0.15:
                    flush()
                    held = []
            held.append(r)
        flush()
        blocks.sort(key=lambda b: -b[2])
        return [(rows[0].doc_id, rows[0].page, k, *b) for k, b in enumerate(blocks)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        names = [f.split()[0] for f in BLOCK.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if held and (r.doc_id, r.page) != (held[0].doc_id, held[0].page):
                    out += fold(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold(held), columns=names)

    return ready.mapInPandas(run, BLOCK)


def items_to_blocks(items: DataFrame) -> DataFrame:
    return cluster_blocks(merge_lines(items))


def _deal(paragraphs: Column, targets: Column, slack: float) -> Column:
    """Paragraphs dealt to boxes in order: each takes what keeps it within its target (plus slack); the last takes the rest."""
    sums = F.aggregate(F.transform(paragraphs, word_count), F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w))

    def dealt(m: Column) -> Column:
        n, last = F.size(m["p"]), F.size(m["t"]) - 1
        state = F.struct(F.array().cast("array<array<string>>").alias("done"), F.lit(0).alias("at"))

        def step(acc: Column, box: Column) -> Column:
            at = acc["at"]
            places = F.sequence(F.least(at + 1, n), n)
            words = lambda j: F.get(m["sums"], j) - F.get(m["sums"], at)
            # A box stops before the paragraph that overfills it, and after the one that fills it.
            over = F.array_min(F.filter(places, lambda j: words(j) > box["target"] + slack)) - 1
            full = F.array_min(F.filter(places, lambda j: words(j) >= box["target"]))
            stop = F.when(box["k"] == last, n).otherwise(F.greatest(at, F.least(F.coalesce(over, n), F.coalesce(full, n), n)))
            return F.struct(F.array_append(acc["done"], F.slice(m["p"], at + 1, stop - at)).alias("done"), stop.alias("at"))

        return F.aggregate(F.transform(m["t"], lambda t, k: F.struct(t.alias("target"), k.alias("k"))), state, step)["done"]

    # An array of one keeps the sums from being made again for each use.
    return F.transform(F.array(F.struct(paragraphs.alias("p"), targets.alias("t"), sums.alias("sums"))), dealt)[0]


def map_paragraphs(paragraphs: Column, blocks: Column) -> Column:
    """Text of each block: one to one where the counts agree, else by the blocks' shares of words."""
    weights = F.transform(blocks, lambda b: F.greatest(word_count(b), F.lit(1)))
    total = F.aggregate(weights, F.lit(0), lambda a, b: a + b)
    words = F.greatest(F.aggregate(F.transform(paragraphs, word_count), F.lit(0), lambda a, b: a + b), F.lit(1))
    dealt = F.transform(_deal(paragraphs, F.transform(weights, lambda w: w / total * words), 0.5), lambda p: F.array_join(p, "\n\n"))
    return F.when(F.size(blocks) == 0, F.array().cast("array<string>")).when(F.size(paragraphs) == F.size(blocks), paragraphs).otherwise(dealt)


def page_distribution(paragraphs: Column, page_words: Column) -> Column:
    """Paragraphs of each page, by the pages' shares of words; the last page drains."""
    weights = F.transform(page_words, lambda w: F.greatest(w, F.lit(1)))
    total = F.aggregate(weights, F.lit(0), lambda a, b: a + b)
    words = F.aggregate(F.transform(paragraphs, word_count), F.lit(0), lambda a, b: a + b)
    return _deal(paragraphs, F.transform(weights, lambda w: F.floor(w / total * words).cast("double")), 0.0)


def slice_words(pages: DataFrame, texts: DataFrame, width: int = scan.INDEXES) -> DataFrame:
    """(doc_id, page, text): a translation's words dealt to pages by rounded shares of the originals' words.

    ``pages`` has doc_id, page, words; ``texts`` doc_id, text.  The last page takes what is left.  Pages travel
    without words; a text meets the list of its pages once.
    """
    totals = pages.groupBy("doc_id").agg(F.greatest(F.sum("words"), F.lit(1)).alias("total"), F.max("page").alias("last"))
    words = texts.select("doc_id", F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "").alias("w"))
    share = pages.select("doc_id", "page", "words").join(totals, "doc_id").join(words.select("doc_id", F.size("w").alias("n")), "doc_id")
    share = share.withColumn("take", round_half_up(F.col("words") / F.col("total") * F.col("n")).cast("long"))
    share = scan.running(share, ["doc_id"], scan.bucket_of(F.col("page"), width), ["page"], upto=F.col("take"))
    end = F.when(F.col("page") == F.col("last"), F.col("n")).otherwise(F.least("upto", "n")).cast("int")
    ranges = share.groupBy("doc_id").agg(F.collect_list(F.struct("page", F.least(F.col("upto") - F.col("take"), F.col("n")).cast("int").alias("start"), end.alias("end"))).alias("ranges"))
    cut = words.join(ranges, "doc_id").select("doc_id", F.inline(F.transform("ranges", lambda r: F.struct(r["page"].alias("page"), F.array_join(F.slice("w", r["start"] + 1, F.greatest(r["end"] - r["start"], F.lit(0))), " ").alias("text")))))
    return cut.select("doc_id", "page", "text")


def wrapped(text: str, width: float, measure: Callable[[str], float]) -> list[str]:
    """Lines of a text: greedy by words, a word wider than the line by characters."""
    out: list[str] = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split():
            trial = f"{line} {word}" if line else word
            if measure(trial) <= width:
                line = trial
                continue
            if line:
                out.append(line)
            line = word
            while len(line) > 1 and measure(line) > width:
                k = next((k for k in range(len(line) - 1, 1, -1) if measure(line[:k]) <= width), 1)
                out.append(line[:k])
                line = line[k:]
        out.append(line)
    return out


def constant_width(share: float = 0.5) -> Callable[[str, float], float]:
    return lambda text, size: len(text) * size * share


#: Units of an em, in which advances are given, and the advance of a character that a table does not have.
EM, ADVANCE = 1_000, 500


class Paragraphs:
    """A text's words with running sums of their characters' advances, for wrapping at any width."""

    def __init__(self, text: str, advances: dict[str, int] | None = None, other: int = ADVANCE) -> None:
        self.parts = []
        for paragraph in text.split("\n"):
            own = " ".join(paragraph.split())
            wide = np.fromiter((advances.get(c, other) for c in own), np.int64, count=len(own)) if advances else np.full(len(own), other, np.int64)
            gaps = np.flatnonzero(np.fromiter((c == " " for c in own), bool, count=len(own)))
            self.parts.append((own, np.concatenate([[0], np.cumsum(wide)]), np.concatenate([gaps, [len(own)]])))

    def lines(self, most: float) -> list[tuple[int, int, int]]:
        """(paragraph, start, end) of lines of at most ``most`` units: greedy by words, a wider word by characters; one binary search a line."""
        out = []
        for k, (own, sums, ends) in enumerate(self.parts):
            start = 0
            while True:
                last = int(np.searchsorted(sums[ends], sums[start] + most, "right")) - 1
                if last >= 0 and ends[last] > start:
                    end, after = int(ends[last]), int(ends[last]) + 1
                else:
                    word = int(ends[np.searchsorted(ends, start, "right")]) if start < len(own) else 0
                    end = min(word, max(start + 1, int(np.searchsorted(sums, sums[start] + most, "right")) - 1))
                    after = end + (end == word)
                out.append((k, start, end))
                start = after
                if start >= len(own):
                    break
        return out

    def text_of(self, line: tuple[int, int, int]) -> str:
        return self.parts[line[0]][0][line[1] : line[2]]


def fit_blocks(blocks: DataFrame, metric: Callable[[str, float], float] | None = None, leading: float = 1.3, advances: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, page, block_idx, size, lines, dropped): text shrunk by steps of 5 per cent, at least to 6 points, until it fits its box.

    Widths come from ``advances``, a font's table of characters in thousandths of an em (without one every
    character is half an em wide), or from ``metric``, a function of a text and a size, for shaped scripts.
    """

    def measured(text: str, width: float) -> tuple[Callable[[float], list], Callable[[list], list[str]]]:
        if metric:
            return lambda size: wrapped(text, width, lambda t: metric(t, size)), lambda lines: lines
        own = Paragraphs(text, advances)
        return lambda size: own.lines(width * EM / size), lambda lines: [own.text_of(x) for x in lines]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                size = min(max(r.font_size, 6.0), 16.0)
                wrap, texts = measured(r.text or "", r.width)
                for _ in range(24):
                    lines = wrap(size)
                    if len(lines) * size * leading <= r.height or size <= 6:
                        break
                    size = max(6.0, size * 0.95)
                room = max(1, int(r.height // (size * leading)))
                out.append((r.doc_id, r.page, r.block_idx, size, texts(lines[:room]), max(0, len(lines) - room)))
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_idx", "size", "lines", "dropped"])

    return blocks.select("doc_id", "page", "block_idx", "text", "width", "height", "font_size").mapInPandas(run, "doc_id long, page int, block_idx int, size double, lines array<string>, dropped int")


def line_bands(items: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Bounding boxes of bands of items whose baselines differ by at most ``tolerance`` from the one before."""
    down = W.partitionBy("doc_id", "page").orderBy(F.desc("y"), "item_idx")
    flagged = items.withColumn("new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(down)) > tolerance).cast("int"), F.lit(0)))
    banded = flagged.withColumn("band", F.sum("new").over(down.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return banded.groupBy("doc_id", "page", "band").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), F.count(F.lit(1)).alias("items"))


def overlay_summary(blocks: DataFrame, paragraphs: DataFrame, fitted: DataFrame) -> DataFrame:
    """(doc_id, mode, blocks, paragraphs, min_size, dropped) of each document."""
    b = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))
    p = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    f = fitted.groupBy("doc_id").agg(F.min("size").alias("min_size"), F.sum("dropped").alias("dropped"))
    out = b.join(p, "doc_id", "left").join(f, "doc_id", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))
    return out.select("doc_id", F.when(F.col("blocks") == F.col("paragraphs"), "matched").otherwise("proportional").alias("mode"), "blocks", "paragraphs", "min_size", "dropped")


def overflow_audit(placed: DataFrame) -> DataFrame:
    """Placed lines that leave their page by more than 2 sideways or their box by more than 1 downwards."""
    return placed.where((F.col("x") < F.col("box_x") - 2) | (F.col("x") + F.col("width") > F.col("box_x") + F.col("box_width") + 2) | (F.col("y") < F.col("box_y") - 1)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("overflows"))
