"""A document's way to another language as one job: chunk, remember, translate, clean, check, merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import once, post_process, prompt
from tessella.operators.chunking import chunk_paragraphs
from tessella.operators.quality import language_qa
from tessella.operators.reports import merged_text, tail

#: (prompt, source text, language) to a reply.
Translator = Callable[[str, str, str], str]


def stub(instructions: str, source: str, lang: str) -> str:
    """Stands in for a translator: marks the text with its language."""
    return f"{lang}: {source}"


def translated(rows: DataFrame, translator: Translator = stub) -> DataFrame:
    """``rows`` (project_id, lang, chunk_index, source_text, context) with a reply each; a translator's error is a null reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str, s: str, lang: str) -> str | None:
            try:
                return translator(p, s, lang)
            except Exception:  # noqa: BLE001  any failure of an injected translator is this row's alone
                return None

        for b in batches:
            yield b[["project_id", "lang", "chunk_index", "source_text"]].assign(reply=[one(*x) for x in zip(b.prompt, b.source_text, b.lang, strict=True)])

    asked = rows.withColumn("prompt", prompt(F.col("lang"), F.col("source_text"), F.col("context")))
    return asked.mapInPandas(run, "project_id long, lang string, chunk_index int, source_text string, reply string")


def localize(docs: DataFrame, languages: list[str], translator: Translator = stub, most: int = 2500, separator: str = r"\n{2,}") -> tuple[DataFrame, DataFrame]:
    """(checked chunks, merged texts) of documents in each of a short list of languages."""
    # A document's chunks come from one row, so each sees the one before it there; no rows need to meet.
    pieces = once(chunk_paragraphs(F.col("text"), most, separator), lambda own: F.transform(own, lambda c, k: F.struct(c.alias("source_text"), tail(F.get(own, k - 1)).alias("context"))))
    cut = docs.select(F.col("doc_id").alias("project_id"), F.posexplode(pieces).alias("chunk_index", "c")).select("project_id", "chunk_index", "c.source_text", "c.context")
    context = cut.select("project_id", F.explode(F.array(*map(F.lit, languages))).alias("lang"), "chunk_index", "source_text", "context")
    replies = translated(context, translator).withColumn("text", post_process(F.coalesce("reply", F.lit("")), F.col("lang"), F.array().cast("array<string>")))
    checked = replies.withColumn("qa", language_qa(F.col("lang"), F.col("source_text"), F.col("text"))).withColumn("status", F.when(F.col("reply").isNull(), "failed").otherwise("done"))
    return checked, merged_text(checked)
