"""Glossary terms in texts: all tables in one pass over each text.

A task builds an Aho-Corasick automaton over the lower-cased terms of a language
and walks each text once, however many terms and tables there are; a term counts
where both its ends are word boundaries.  A glossary of up to ``MOST`` terms (its
size is checked) goes to every task.  A larger one is dealt into shards of about so
many: texts and shards then meet by shard and by a salt of the text, so that no
language, however many of the texts it has, is one task's work, and no task holds
more than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms that an automaton holds.
MOST = 50_000
#: Rows of whole texts that travel to Python together.
TOGETHER = 1_000
HITS = "array<struct<tag:string,term:string,form:string>>"
HIT = pa.list_(pa.struct([("tag", pa.string()), ("term", pa.string()), ("form", pa.string())]))


def glossary(**tables: DataFrame | None) -> DataFrame:
    """Tables of (lang, source, target) as one of (tag, exact, lang, term, form); a name that begins with ``exact_`` is compared with its case."""
    made = [t.select(F.lit(n.removeprefix("exact_")).alias("tag"), F.lit(n.startswith("exact_")).alias("exact"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("term"), F.col("target").cast("string").alias("form")) for n, t in tables.items() if t is not None]
    out = made[0]
    for own in made[1:]:
        out = out.union(own)
    return out.where("term <> ''")


def lowered(text: str) -> str:
    """A text in lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


class Matcher:
    """Automata of a glossary's languages; ``rows`` are (tag, exact, lang, term, form)."""

    def __init__(self, rows: Sequence[tuple]) -> None:
        import ahocorasick

        self.by_lang: dict = {}
        for tag, exact, lang, term, form in rows:
            low = lowered(term)
            automaton = self.by_lang.setdefault(lang, ahocorasick.Automaton())
            if low not in automaton:
                automaton.add_word(low, (len(low), []))
            automaton.get(low)[1].append((tag, exact, term, form))
        for automaton in self.by_lang.values():
            automaton.make_automaton()

    def find(self, lang: str | None, text: str | None) -> list[dict]:
        """Hits of a text, each of the glossary's rows once, in order of their terms' ends."""
        automaton = self.by_lang.get(lang)
        if automaton is None or not text:
            return []
        low, found = lowered(text), {}
        for end, (size, rows) in automaton.iter(low):
            start = end + 1 - size
            begins = _is_word(low[start]) != (start > 0 and _is_word(low[start - 1]))
            if begins and _is_word(low[end]) != (end + 1 < len(low) and _is_word(low[end + 1])):
                for k, (tag, exact, term, form) in enumerate(rows):
                    if not exact or text[start : end + 1] == term:
                        found[size, low[start : end + 1], k] = {"tag": tag, "term": term, "form": form}
        return list(found.values())


def _few_rows(spark: SparkSession) -> None:
    """Smaller batches of texts for Python, unless the session has a size of its own."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) == 10_000:
        spark.conf.set(setting, str(TOGETHER))


def with_hits(texts: DataFrame, terms: DataFrame, column: str = "source", key: Sequence[str] = (), most: int = MOST, salts: int | None = None) -> DataFrame:
    """``texts`` with ``hits``: the glossary's rows (see ``glossary``) whose term occurs in ``column`` as a whole word, by ``lang``.

    ``key`` names columns that tell the texts apart; a glossary of more than ``most`` terms needs them.
    """
    rows = [tuple(r) for r in terms.select("tag", "exact", "lang", "term", "form").limit(most + 1).collect()]
    if len(rows) <= most:
        _few_rows(texts.sparkSession)

        @F.arrow_udf(HITS)
        def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            own = Matcher(rows)
            for langs, values in batches:
                # Text by text from Arrow's memory: a batch's texts are never all Python strings at once.
                yield pa.array((own.find(a.as_py(), b.as_py()) for a, b in zip(langs, values, strict=True)), HIT)

        return texts.withColumn("hits", hits(F.col("lang").cast("string"), F.col(column)))
    if not key:
        raise ValueError("a glossary of several shards needs a key of the texts")
    return _sharded(texts, terms, column, list(key), most, salts)


def _sharded(texts: DataFrame, terms: DataFrame, column: str, key: list[str], most: int, salts: int | None) -> DataFrame:
    shards = -(-terms.count() // most) + 1
    salts = salts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    shard = F.pmod(F.xxhash64("lang", "term", "tag", "form"), F.lit(shards)).alias("_shard")
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    own = terms.select(shard, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("_salt"), F.lit(0).alias("_kind"), "lang", "tag", "exact", "term", "form", none("_text", "string"), *(none(f"_k{n}", types[c]) for n, c in enumerate(key)))
    asked = texts.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("_shard"), F.pmod(F.xxhash64(*key), F.lit(salts)).alias("_salt"), F.lit(1).alias("_kind"), F.col("lang").cast("string").alias("lang"), none("tag", "string"), none("exact", "boolean"), none("term", "string"), none("form", "string"), F.col(column).alias("_text"), *(F.col(c).alias(f"_k{n}") for n, c in enumerate(key)))
    names = [f"_k{n}" for n in range(len(key))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, matcher = None, [], None
        for batch in batches:
            out, at = [], []
            columns = [batch.column(c).to_pylist() for c in ("_shard", "_salt", "_kind", "tag", "exact", "lang", "term", "form", "_text")]
            for n, (a, b, kind, tag, exact, lang, term, form, text) in enumerate(zip(*columns, strict=True)):
                if (a, b) != unit:
                    unit, rows, matcher = (a, b), [], None
                if kind == 0:
                    rows.append((tag, exact, lang, term, form))
                else:
                    matcher = matcher or Matcher(rows)
                    if found := matcher.find(lang, text):
                        at.append(n)
                        out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in names), pa.array(out, HIT)], names=[*names, "h"])

    met = own.union(asked).repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_kind").mapInArrow(run, ", ".join(f"{n} {types[c]}" for n, c in zip(names, key, strict=True)) + f", h {HITS}")
    each = met.groupBy(*names).agg(F.flatten(F.collect_list("h")).alias("hits"))
    same = F.lit(True)
    for n, c in zip(names, key, strict=True):
        same = same & texts[c].eqNullSafe(F.col(n))
    return texts.join(each, same, "left").drop(*names).withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))


def tagged(hits: Column, tag: str) -> Column:
    return F.filter(hits, lambda h: h["tag"] == tag)
