"""License scans (operator 1), by DataFrame functions alone.

A text's lines, its blocks (between blank lines) and its runs of several blocks
are normalised to lower-case words and compared with license templates by the
Dice coefficient over distinct word bigrams.  Dice >= t needs sizes within a
factor of (2 - t) / t, which prunes templates before any comparison, and it needs
at least t / (2 - t) of the template's bigrams.  Words that touch more than the
rest of them are its anchors: a text without any template's anchor matches nothing
and is not split at all.  The templates are a fixed short list; nothing is shuffled.

Notices are published in several paragraphs, and paragraphs repeat.  From every
block that can start a run, a fold unites the bigrams of the blocks that follow,
until there are more distinct ones than any template allows; their number only
grows, so no run is lost, however many words it has.  The fold looks at a bounded
stretch of blocks first, and at all that follow where repeats leave it open.  Runs of
one start with the same bigrams are one row.  In a row of more than two equal
blocks those between the first and the last start no run, as they would repeat
what the first one gives, and cost the fold nothing.

Edge cases: null and empty texts and segments of fewer than two words match
nothing; a segment has one best template, ties going to the first name; equal
lines and blocks of a text count once, at their first place; runs of blocks may
overlap and each that matches is a row; a null id is an id like any other and
repeated rows each have their matches; very long segments are handled as any
other; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import text_or_empty

THRESHOLD = 0.8
#: Words that make poor anchors.
FREQUENT = frozenset("a above all an and any as at be by for from in is it may of on or that the this to under use with without work you".split())
#: Public license notices (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-line": "Licensed under the BSD 3-Clause License.",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0-line": "Released under CC0 1.0 Universal, public domain dedication.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies.""",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: str) -> list[str]:
    """The words of a template, as ``words`` makes them from a column."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def words(text: Column) -> Column:
    """Lower-case words; runs of anything but letters and digits part them."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def bigrams(own: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(own) > 1, F.array_distinct(pairs))


def segments(text: Column) -> Column:
    """Distinct lines and blocks of a text."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n")))


def blocks(text: Column) -> Column:
    """Blocks that have words: the words and their bigrams."""
    split = F.filter(F.split(text, r"\n[ \t]*\n"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    return F.transform(F.transform(split, words), lambda w: F.struct(w.alias("w"), F.coalesce(bigrams(w), F.array().cast("array<string>")).alias("b")))


def placed(own: Column) -> Column:
    """Blocks with their places, less those that equal both blocks before them; ``to`` is the last place of such repeats."""
    at = F.transform(own, lambda x, i: F.struct(i.alias("at"), x["w"].alias("w"), x["b"].alias("b")))
    return F.filter(at, lambda x, i: (i < 2) | (x["w"] != F.get(own, i - 1)["w"]) | (x["w"] != F.get(own, i - 2)["w"]))


def grown(own: Column, start: Column, length: Column, most: int, best: Callable[[Column], Column]) -> Column:
    """Fold of ``length`` blocks from ``start`` (from 1): where the bigrams grow, the best template there, and whether and where they pass ``most``."""
    none = F.array().cast("array<struct<at:int,m:struct<d:double,license:string>>>")
    state = F.struct(F.array().cast("array<string>").alias("b"), F.lit("").alias("last"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("closed"), none.alias("found"))

    def longer(state: Column, block: Column) -> Column:
        joint = F.when(state["k"] > 0, F.array(F.concat(state["last"], F.lit(" "), F.get(block["w"], F.lit(0))))).otherwise(F.array().cast("array<string>"))
        return F.when(state["closed"].isNotNull(), state).otherwise(F.transform(F.array(F.array_union(state["b"], F.concat(joint, block["b"]))), lambda b: F.struct(
            b.alias("b"), F.element_at(block["w"], -1).alias("last"), (state["k"] + 1).alias("k"), F.when(F.size(b) > most, block["at"]).alias("closed"),
            F.when((F.size(b) <= most) & ((F.size(b) > F.size(state["b"])) | (state["k"] == 0)), F.array_append(state["found"], F.struct(block["at"].alias("at"), best(b).alias("m")))).otherwise(state["found"]).alias("found"),
        ))[0])

    return F.aggregate(F.slice(own, start, length), state, longer, lambda s: F.struct(s["closed"].alias("closed"), s["found"].alias("found")))


def runs(own: Column, n: Column, most: int, anchored: Callable[[Column], Column], best: Callable[[Column], Column]) -> Column:
    """(segment, blocks, most_blocks, m) of the runs of two or more blocks that match; ``own`` is what ``placed`` gives, of ``n`` blocks."""
    stretch = most + 2
    starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.exists(F.slice(own, i, F.lit(stretch)), lambda x: anchored(F.array_join(x["w"], " "))) | (i + stretch <= F.size(own)))
    short = F.transform(starts, lambda i: F.struct(i.alias("i"), grown(own, i, F.lit(stretch), most, best).alias("r")))
    whole = F.transform(short, lambda x: F.struct(x["i"].alias("i"), F.when(x["r"]["closed"].isNull() & (x["i"] + stretch <= F.size(own)), grown(own, x["i"], F.size(own), most, best)).otherwise(x["r"]).alias("r")))

    def rows(x: Column) -> Column:
        first = F.coalesce(F.get(own, x["i"])["at"], n) - 1  # the last of equal blocks
        found, closed = x["r"]["found"], F.coalesce(x["r"]["closed"], n)
        each = F.transform(found, lambda f, k: F.struct(
            first.alias("segment"), F.greatest(F.lit(2), f["at"] - first + 1).alias("blocks"), (F.coalesce(F.get(found, k + 1)["at"], closed) - first).alias("most_blocks"), f["m"].alias("m"),
        ))
        return F.filter(each, lambda r: r["m"].isNotNull() & (r["most_blocks"] > 1))

    return F.flatten(F.transform(whole, rows))


def anchors(words_of: list[str], least: float) -> set[str]:
    """Words, long ones first, of which any text that matches the template holds one."""
    pairs = {(a, b) for a, b in zip(words_of, words_of[1:], strict=False)}
    found: set[str] = set()
    for word in sorted(set(words_of), key=lambda w: (w in FREQUENT, -len(w), w)):
        if sum(bool(found.intersection(p)) for p in pairs) > (1 - least) * len(pairs) + 1e-9:
            break
        found.add(word)
    return found


def may_match(text: Column, every: set[str]) -> Column:
    """Whether a text holds any anchor; short ones only as whole words."""
    low = F.lower(text)
    long = sorted(w for w in every if len(w) > 3)
    short = sorted(every.difference(long))
    tests = [low.contains(w) for w in long if not any(o != w and o in w for o in long)]
    if short:
        tests.append(low.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(short) + r")(?![\p{L}\p{N}])"))
    return reduce(lambda a, b: a | b, tests)


def run_size(sizes: Iterable[int], least: float) -> int:
    """Most bigrams of anything that matches, from the templates' numbers of them."""
    return int(max(sizes) / least + 1e-9)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, segment, blocks, most_blocks, license, dice: every segment that is a license, with its best template.

    Where ``blocks`` is 1, ``segment`` counts a text's distinct lines and blocks from 0; otherwise it is the
    first of a run, counted from 0 among the blocks that have words: all runs from there of ``blocks`` to
    ``most_blocks`` blocks have the same bigrams.  ``dice`` is rounded to six places.
    """
    split = {name: w for name, text in sorted((TEMPLATES if templates is None else templates).items()) if len(w := normalised(text)) > 1}
    if not split:
        raise ValueError("no template has two words")
    sets = {name: sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for name, w in split.items()}
    least = threshold / (2 - threshold)
    every = set().union(*(anchors(w, least) for w in split.values()))
    most = run_size(map(len, sets.values()), least)

    def against(b: Column, name: str, own: list[str]) -> Column:
        n, size = F.size(b), len(own)
        dice = 2 * F.size(F.array_intersect(b, F.array(*map(F.lit, own)))) / (n + size)
        fits = (n >= size * least - 1e-9) & (n * least <= size + 1e-9)
        return F.when(fits, F.struct(F.round(dice, 6).alias("dice"), F.lit(name).alias("license")))

    def best(b: Column) -> Column:
        """The highest Dice, then the first name."""
        each = F.filter(F.array(*(against(b, name, own) for name, own in sets.items())), lambda m: m.isNotNull() & (m["dice"] >= threshold))
        return F.array_min(F.transform(each, lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    single = texts.where(may_match(F.col("t"), every)).select("doc_id", F.posexplode(segments(F.col("t"))).alias("segment", "s")).where(may_match(F.col("s"), every))
    # Exploding an array of one keeps bigrams and blocks from being made again for each use.
    single = single.select("doc_id", "segment", F.explode(F.array(bigrams(words(F.col("s"))))).alias("b")).where(F.size("b") > 0)
    single = single.select("doc_id", "segment", F.lit(1).alias("blocks"), F.lit(1).alias("most_blocks"), best(F.col("b")).alias("m")).where("m is not null")
    parted = texts.where(F.col("t").rlike(r"\n[ \t]*\n") & may_match(F.col("t"), every)).select("doc_id", F.explode(F.array(blocks(F.col("t")))).alias("every")).where(F.size("every") > 1)
    parted = parted.select("doc_id", F.size("every").alias("n"), F.explode(F.array(placed(F.col("every")))).alias("own"))
    several = parted.select("doc_id", F.inline(runs(F.col("own"), F.col("n"), most, lambda t: may_match(t, every), best)))
    return single.unionByName(several).select("doc_id", "segment", "blocks", "most_blocks", "m.license", (-F.col("m.d")).alias("dice"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same over all pairs of templates and segments that hold a word every template has one of; nothing is pruned by size."""
    rows = ", ".join(f"({_literal(name)}, {_literal(' '.join(normalised(text)))})" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH lines AS (
  SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10)), string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n')) AS l FROM documents
), numbered AS (
  SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM lines
), firsts AS (
  SELECT doc_id, s, min(pos) AS pos FROM numbered GROUP BY doc_id, s
), segments AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS segment FROM firsts
), parts AS (
  SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n') AS l FROM documents)
), blocks AS (
  SELECT doc_id, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i
  FROM parts WHERE regexp_matches(s, '[\\p{{L}}\\p{{N}}]')
), starts AS (
  SELECT *, lag(s) OVER w = s AND lead(s) OVER w = s AS inner_ FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), candidates AS (
  SELECT doc_id, segment, 1 AS blocks, s FROM segments UNION ALL
  SELECT a.doc_id, a.i, b.i - a.i + 1, string_agg(p.s, ' ' ORDER BY p.i) FROM starts a JOIN blocks b ON b.doc_id = a.doc_id AND b.i > a.i JOIN blocks p ON p.doc_id = a.doc_id AND p.i BETWEEN a.i AND b.i
  WHERE a.inner_ IS NOT TRUE GROUP BY a.doc_id, a.i, b.i
), worded AS (
  SELECT doc_id, segment, blocks, string_split(trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM candidates
  WHERE regexp_matches(lower(s), 'licen|rights|redistribut|permission|software|mozilla|public')
), pairs AS (
  SELECT DISTINCT doc_id, segment, blocks, w[i] || ' ' || w[i + 1] AS b FROM (SELECT doc_id, segment, blocks, w, unnest(range(1, len(w))) AS i FROM worded WHERE len(w) > 1)
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, segment, blocks) AS n FROM pairs
), templates(license, t) AS (VALUES {rows}
), template_words AS (
  SELECT license, string_split(t, ' ') AS w FROM templates
), template_pairs AS (
  SELECT DISTINCT license, w[i] || ' ' || w[i + 1] AS b FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM template_words)
), template_sized AS (
  SELECT *, count(*) OVER (PARTITION BY license) AS m FROM template_pairs
), scored AS (
  SELECT doc_id, segment, blocks, n, license, round(2.0 * count(*) / (n + m), 6) AS dice FROM sized JOIN template_sized USING (b) GROUP BY doc_id, segment, blocks, license, n, m
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, segment, blocks ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= {THRESHOLD}
)
SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(min(blocks) AS INTEGER) AS blocks, CAST(max(blocks) AS INTEGER) AS most_blocks, license, CAST(dice AS DOUBLE) AS dice
FROM ranked WHERE r = 1 GROUP BY doc_id, segment, n, license, dice, blocks = 1"""
