"""Quality of (source, output) pairs: phase checks, language checks and the reply contract.

Token arrays that several checks need are made once, in a projection of their
own; checks are columns of one projection and become rows only at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.functions.text import (
    SPACE, detect_explicit, has_artifacts, holds, is_blank, latin_words, looks_like_echo, once, profanities, qa_word_count, regexp_total, round_half_up, trim_all, without_marks, word_count,
)
from tessella.operators.terms import glossary, tagged, with_hits


def ratio_status(matched: Column, present: Column) -> Column:
    ratio = F.when(present == 0, 1.0).otherwise(matched / F.greatest(present, F.lit(1)))
    return F.when(ratio >= 0.8, "pass").when(ratio >= 0.5, "warn").otherwise("fail")


def fuzzy_hit(output: Column, target: Column) -> Column:
    """The output holds the form, or (from three letters) the form without its last letter."""
    low, form = F.lower(output), F.lower(trim_all(target))
    cut = F.substr(form, F.lit(1), F.greatest(F.lit(3), F.length(form) - 1))
    return F.contains(low, form) | ((F.length(form) >= 3) & F.contains(low, cut))


def met_terms(hits: Column, output: Column, exact: bool = False) -> tuple[Column, Column]:
    """(present, matched): how many hits there are, and of how many the output has the form; an exact one letter by letter, and the name itself where there is no form."""
    good = F.filter(hits, lambda h: F.contains(output, F.coalesce(h["form"], h["term"])) if exact else F.coalesce(fuzzy_hit(output, h["form"]), F.lit(False)))
    return F.size(hits).cast("long"), F.size(good).cast("long")


def term_hits(pairs: DataFrame, terms: DataFrame, exact: bool = False) -> DataFrame:
    """(unit_id, present, matched, status) of each row of pairs: glossary terms (lang, source, target) in the source, and those whose form the output has.

    A glossary of more than ``terms.MOST`` rows needs units that occur once; with a smaller one each row has its own counts.
    """
    found = with_hits(pairs, glossary(**{"exact_t" if exact else "t": terms}), "source", ["unit_id"])
    present, matched = met_terms(F.col("hits"), F.col("output"), exact)
    return found.select("unit_id", present.alias("present"), matched.alias("matched")).withColumn("status", ratio_status(F.col("matched"), F.col("present")))


def literal_bridge(source_words: Column, output_words: Column) -> Column:
    """Share of the output's Latin words, counted with repeats, that the source has too."""
    shared = F.filter(output_words, lambda w: F.array_contains(source_words, w))
    return F.when(F.size(output_words) == 0, 0.0).otherwise(F.size(shared) / F.size(output_words))


def dialogue_pairs(text: Column) -> Column:
    return F.least(regexp_total(text, '["“„«「『]'), regexp_total(text, '["”»」』]'))


def dialogue_kept(source: Column, output: Column) -> Column:
    before, after = dialogue_pairs(source), dialogue_pairs(output)
    return (before == 0) | (F.abs(after - before) <= F.greatest(F.lit(1), round_half_up(before * 0.6).cast("int")))


def quote_status(output: Column, lang: Column) -> Column:
    opened = F.size(F.split(output, F.concat(F.lit(r"\Q"), rules.rule(lang, "quote_open"), F.lit(r"\E")), -1)) - 1
    closed = F.size(F.split(output, F.concat(F.lit(r"\Q"), rules.rule(lang, "quote_close"), F.lit(r"\E")), -1)) - 1
    return F.when((F.abs(opened - closed) <= 1) & (regexp_total(output, "[\"']") <= 2), "pass").otherwise("warn")


def thought_status(output: Column) -> Column:
    return F.when(regexp_total(output, r"\*[^*]+\*") > 0, "warn").when(F.abs(regexp_total(output, "[「『【]") - regexp_total(output, "[」』】]")) > 1, "warn").otherwise("pass")


def length_ratio(source: Column, output: Column) -> Column:
    return qa_word_count(output) / F.greatest(qa_word_count(source), F.lit(1))


def length_status(source: Column, output: Column, lang: Column) -> Column:
    ratio, script = length_ratio(source, output), rules.rule(lang, "script")
    low = F.when(script.isin("Chinese", "Japanese", "Hangul"), 0.3).when(script.isin("Arabic", "Cyrillic", "Devanagari", "Bengali"), 0.4).otherwise(0.5)
    high = F.when(script.isin("Chinese", "Japanese", "Hangul"), 1.5).when(script.isin("Arabic", "Cyrillic", "Devanagari", "Bengali"), 2.2).otherwise(2.0)
    return F.when((ratio >= low) & (ratio <= high), "pass").otherwise("warn")


def chapter_lines(text: Column) -> Column:
    # Compared code point by code point, so lower-casing needs no locale.
    return F.size(F.filter(F.split(F.lower(text), "\n"), lambda line: line.rlike("|".join(rules.CHAPTER_WORDS))))


def chapter_status(source: Column, output: Column) -> Column:
    before, after = chapter_lines(source), chapter_lines(output)
    return F.when((before == 0) | (F.abs(after - before) <= F.greatest(F.lit(1.0), before * 0.3)), "pass").otherwise("warn")


def widest_line(output: Column, lang: Column) -> Column:
    """Units of the widest line: 1 for a CJK character, less for others."""
    script = rules.rule(lang, "script")
    factor = F.when(script.isin("Chinese", "Japanese", "Hangul"), 1.0).when(script == "Arabic", 0.75).otherwise(0.6)
    wide = lambda line: regexp_total(line, r"[　-ヿ㐀-鿿가-힯]")
    return F.array_max(F.transform(F.split(output, "\n"), lambda line: wide(line) + (F.length(line) - wide(line)) * factor))


def script_issues(output_words: Column, output: Column, lang: Column) -> Column:
    """Issues of direction and script: a missing right-to-left mark, English left over, or any other Latin word."""
    unmarked = lang.isin(rules.RTL) & ~output.rlike(r"[‏‫]")
    foreign = rules.rule(lang, "script") != "Latin"
    # English function words and other Latin words weigh the same.
    return unmarked.cast("int") + (foreign & (F.size(output_words) > 0)).cast("int")


#: Phases that no rule can check always pass.
GATES = [5, 7, 11, 12, 18, 20]


def phase_checks(pairs: DataFrame, terms: DataFrame, names: DataFrame | None = None, memory: DataFrame | None = None, core: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """(unit_id, phase, status), one row for each of 23 phases.  ``pairs`` has unit_id, lang, source, output.

    The tables of terms, names, core terms, ranks and term memory have lang,
    source and target; a null target is a term that the language has no form
    for, which counts as present and never as matched; a name without a form stands for itself.  Names are
    compared with their case, whole; the other tables are not.  Without a table its phase passes.
    """
    tables = {"p1": terms, "exact_p2": names, "p9": core, "p15": ranks, "p21": memory}
    base = pairs.select("unit_id", "lang", "source", "output")
    given = {n.removeprefix("exact_"): n.startswith("exact_") for n, t in tables.items() if t is not None}
    # One pass over each source finds the terms of all tables.
    base = with_hits(base, glossary(**tables), "source", ["unit_id"]) if given else base
    counts = {n: met_terms(tagged(F.col("hits"), n), F.col("output"), exact) for n, exact in given.items()}
    status_of = {n: ratio_status(m, p) if n != "p21" else F.when(m == p, "pass").otherwise("warn") for n, (p, m) in counts.items()}
    base = base.select("unit_id", "lang", "source", "output", latin_words(F.col("source")).alias("sw"), latin_words(F.col("output")).alias("ow"), *(status_of.get(n, F.lit("pass")).alias(n) for n in ("p1", "p2", "p9", "p15", "p21")))
    s, o, lang, warn = F.col("source"), F.col("output"), F.col("lang"), lambda bad: F.when(bad, "warn").otherwise("pass")
    issues = script_issues(F.col("ow"), o, lang)
    status = {
        1: F.col("p1"), 2: F.col("p2"), 3: warn(literal_bridge(F.col("sw"), F.col("ow")) > 0.6), 4: warn(~dialogue_kept(s, o)), 6: warn(detect_explicit(o)),
        8: F.when(issues == 0, "pass").when(issues == 1, "warn").otherwise("fail"), 9: F.col("p9"), 10: quote_status(o, lang), 13: warn(detect_explicit(o)), 14: warn(F.size(profanities(o)) > 0),
        15: F.col("p15"), 16: thought_status(o), 17: length_status(s, o, lang), 19: chapter_status(s, o), 21: F.col("p21"), 22: warn(widest_line(o, lang) > 120),
    } | {g: F.lit("pass") for g in GATES}
    rows = base.select("unit_id", ((rules.rule(lang, "script") != "Latin") & (F.size("ow") > 0)).alias("left"), F.array(*(F.struct(F.lit(p).alias("phase"), c.alias("status")) for p, c in sorted(status.items()))).alias("checks"))
    final = F.struct(F.lit(23).alias("phase"), warn(F.exists("checks", lambda c: c["status"] != "pass") | F.col("left")).alias("status"))
    return rows.select("unit_id", F.explode(F.array_append("checks", final)).alias("c")).select("unit_id", "c.phase", "c.status")


def qa_rollup(checks: DataFrame) -> DataFrame:
    """(unit_id, passes, warns, fails, score, overall)."""
    agg = checks.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("status") == s).alias(f"{s}s".replace("passs", "passes")) for s in ("pass", "warn", "fail")))
    score = F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(100 - F.col("fails") * 25 / F.col("n") - F.col("warns") * 8 / F.col("n")))).cast("int")
    return agg.select("unit_id", "passes", "warns", "fails", score.alias("score"), F.when(F.col("fails") > 0, "fail").when(F.col("warns") > 0, "warn").otherwise("pass").alias("overall"))


def language_qa(lang: Column, source: Column, output: Column, least_script: float = 0.5, most_english: float = 0.25) -> Column:
    """(failures, score, script_ratio, length_ratio): the names of failed checks, in order."""
    return once(without_marks(output), lambda t: _language_checks(lang, source, t, least_script, most_english))


def _measures(lang: Column, source: Column, t: Column) -> Column:
    """What the language checks look at, each made once."""
    paragraphs = lambda x: F.filter(F.split(x, r"\n{2,}"), lambda p: ~is_blank(p))
    # Letters of the script are taken in runs; English words count in other scripts alone.
    in_script = lambda r: F.length(F.array_join(F.regexp_extract_all(t, F.lit(f"[{r[6]}]+"), F.lit(0)), ""))
    foreign = lambda n: F.when(rules.rule(lang, "script") != "Latin", n).otherwise(0)
    return F.struct(
        F.length(t).alias("n"), is_blank(t).alias("blank"), rules.per_language(lang, in_script).alias("script"), foreign(regexp_total(t, r"\b[A-Za-z]{3,}\b")).alias("english"),
        foreign(regexp_total(t, r"[\p{L}\p{M}]+")).alias("letters"), word_count(t).alias("words"), F.length(source).alias("source_n"), word_count(source).alias("source_words"),
        F.transform(paragraphs(t), lambda p: F.substring(trim_all(p), 1, 80)).alias("keys"), F.size(paragraphs(source)).alias("source_paragraphs"),
        (holds(t, "<<<", "SECTION_") & t.rlike(r"<<<\s*[A-Z]+_|SECTION_[AB]_")).alias("leak"), has_artifacts(t).alias("artifacts"), F.contains(t, F.lit("�")).alias("replacement"),
    )


def _ratios(lang: Column, m: Column) -> Column:
    cjk = rules.rule(lang, "cjk_native")
    ratio = F.when(cjk, F.when(m["source_n"] > 0, m["n"] / m["source_n"]).otherwise(0.0)).otherwise(F.when(m["source_words"] > 0, m["words"] / m["source_words"]).otherwise(0.0))
    return F.struct(m.alias("m"), (m["script"] / F.greatest(m["n"], F.lit(1))).alias("script"), ratio.alias("ratio"))


def _language_checks(lang: Column, source: Column, t: Column, least_script: float, most_english: float) -> Column:
    return once(once(_measures(lang, source, t), lambda m: _ratios(lang, m)), lambda r: _verdict(lang, r["m"], r["script"], r["ratio"], least_script, most_english))


def _verdict(lang: Column, m: Column, script: Column, ratio: Column, least_script: float, most_english: float) -> Column:
    empty, foreign, cjk = m["blank"], rules.rule(lang, "script") != "Latin", rules.rule(lang, "cjk_native")
    odd = F.when(cjk, (ratio > 0) & ((ratio < 0.2) | (ratio > 4))).otherwise((ratio > 0) & ((ratio < 0.35) | (ratio > 3.5)))
    tests = [
        ("empty", empty), ("script_ratio", foreign & ~empty & (script < least_script)), ("english", foreign & ~empty & (m["english"] / F.greatest(m["letters"], F.lit(1)) > most_english)),
        ("length_ratio", ~empty & odd), ("source_echo", ~empty & ((rules.rule(lang, "direction") == "rtl") | foreign) & (ratio > 0.4) & (script < 0.3)),
        ("delimiter_leak", m["leak"]), ("artifacts", m["artifacts"]), ("replacement", m["replacement"]),
        ("missing_paragraphs", (m["source_paragraphs"] > 0) & (F.size(m["keys"]) < F.floor(m["source_paragraphs"] * 0.6))), ("duplicate_paragraphs", (F.size(m["keys"]) > F.size(F.array_distinct(m["keys"]))) & (F.size(m["keys"]) > 2)),
    ]
    failures = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())
    return once(failures, lambda f: F.struct(f.alias("failures"), F.greatest(F.lit(0), 100 - 20 * F.size(f)).alias("score"), script.alias("script_ratio"), ratio.alias("length_ratio")))


CHECKS = ("fullyTargetLanguage", "noMarkers", "completeSentences", "glossaryRespected")


def parse_contract(raw: Column) -> Column:
    """(kind, reason): kind is single or pair where the reply is a valid contract, else reason says why not.

    Types come from the parsed value's own schema, since a typed reader would coerce them.
    """
    text = trim_all(F.coalesce(raw, F.lit("")))
    v = F.try_parse_json(text)
    shape = F.schema_of_variant(v)

    def single(value: Column, kind: str) -> Column:
        get = lambda path, type_="string": F.try_variant_get(value, path, type_)
        type_of = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        out = F.when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), f"{kind}_not_an_object")
        out = out.when((F.coalesce(type_of("$.translation"), F.lit("")) != "STRING") | (trim_all(F.coalesce(get("$.translation"), F.lit(""))) == ""), f"{kind}_missing_or_empty_translation")
        out = out.when(~F.startswith(F.coalesce(type_of("$.selfCheck"), F.lit("")), F.lit("OBJECT")), f"{kind}_missing_selfCheck")
        for name in CHECKS:
            out = out.when(F.coalesce(type_of(f"$.selfCheck.{name}"), F.lit("")) != "BOOLEAN", f"{kind}_selfCheck_{name}_not_boolean")
        return out

    items = F.try_variant_get(v, "$.items", "array<variant>")
    item_faults = F.filter(F.transform(items, lambda i: single(i, "pair_item")), lambda r: r.isNotNull())
    reason = (
        F.when(text == "", "empty_response").when(v.isNull(), "invalid_json").when(~F.startswith(shape, F.lit("OBJECT")), "not_an_object")
        .when(items.isNotNull() & (F.size(item_faults) > 0), F.get(item_faults, F.lit(0))).when(items.isNotNull() & (F.size(items) == 0), "empty_items").when(items.isNull(), single(v, "single"))
    )
    return F.struct(F.when(reason.isNull(), F.when(items.isNotNull(), "pair").otherwise("single")).alias("kind"), reason.alias("reason"))


#: Patterns of labels that leak at the head of a reply (fixed values).
MARKERS = [
    rf"(?i)^{SPACE}*paragraph{SPACE}*#?{SPACE}*[0-9]+{SPACE}*[:.)-]?", rf"(?i)^{SPACE}*sentence{SPACE}*#?{SPACE}*[0-9]+{SPACE}*[:.)-]?", rf"(?i)^(?:{SPACE}|[【\[])*(?:paragraph|sentence){SPACE}*#?{SPACE}*[0-9]+[】\]]?{SPACE}*",
    rf"(?i)^{SPACE}*(?:translation|output|result|translated text){SPACE}*[:：]", rf"(?i)^{SPACE}*(?:here(?:'s| is) (?:the|your) translation|sure|certainly)\b",
]


def _matches(pattern: str):
    return lambda line: line.rlike(pattern)


def marker_count(text: Column) -> Column:
    """How many of six patterns match: five on the first five lines, the code fence anywhere."""
    head = F.slice(F.split(text, "\n"), 1, 5)
    return reduce(add, (F.exists(head, _matches(p)).cast("int") for p in MARKERS), F.contains(text, F.lit("```")).cast("int"))


def echo_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z \t\n\r\f]", " "), r"[ \t\n\r\f]+"), lambda w: w != "")


def source_echo(source: Column, output: Column, width: int = 8, stride: int = 4) -> Column:
    """More than a quarter of the source's windows of eight words occur, word by word, in the output."""
    s, o = echo_words(source), F.array_distinct(echo_words(output))
    windows = F.sequence(F.lit(0), F.greatest(F.size(s) - width, F.lit(0)), F.lit(stride))
    met = F.size(F.filter(windows, lambda i: F.forall(F.slice(s, i + 1, width), lambda w: F.array_contains(o, w))))
    return (F.size(s) >= 24) & (met / F.size(windows) > 0.25)


def wrong_language(text: Column, lang: Column) -> Column:
    letters = F.regexp_replace(text, r"[\s\d\p{P}\p{S}]", "")
    out = F
    for code, ranges in rules.TARGET_SCRIPTS.items():
        out = out.when(lang == code, (F.length(letters) >= 12) & (regexp_total(text, f"[{ranges}]") / F.greatest(F.length(letters), F.lit(1)) < 0.5))
    return out.otherwise(F.lit(False))


def missing_terms(output: Column, locked: Column) -> Column:
    """Sources of locked terms (array of source, target) whose form the output lacks."""
    return F.transform(F.filter(locked, lambda t: (F.length(t["target"]) > 1) & ~F.contains(F.lower(output), F.lower(t["target"]))), lambda t: t["source"])


def validate_chunk(raw: Column, lang: Column, source: Column, locked: Column, retried: Column) -> Column:
    """(action, reason): accept, or at the first failed step retry_strict and, after a retry, needs_review."""
    parsed = parse_contract(raw)
    v = F.try_parse_json(trim_all(F.coalesce(raw, F.lit(""))))
    text = F.try_variant_get(v, "$.translation", "string")
    false_checks = F.filter(F.array(*(F.when(~F.coalesce(F.try_variant_get(v, f"$.selfCheck.{c}", "boolean"), F.lit(False)), F.lit(c)) for c in CHECKS)), lambda x: x.isNotNull())
    absent = missing_terms(text, locked)
    reason = (
        F.when(parsed["reason"].isNotNull(), parsed["reason"]).when(parsed["kind"] == "pair", "pair_envelope_in_single_call")
        .when(F.size(false_checks) > 0, F.concat(F.lit("selfCheck_false:"), F.array_join(false_checks, ","))).when(marker_count(text) > 0, F.concat(F.lit("markers_detected:"), marker_count(text).cast("string")))
        .when(source_echo(source, text), "source_echo").when(wrong_language(text, lang), F.concat(F.lit("wrong_language:"), lang)).when(F.size(absent) > 0, F.concat(F.lit("glossary_missing:"), F.array_join(F.slice(absent, 1, 3), "|")))
    )
    return F.struct(F.when(reason.isNull(), "accept").when(retried, "needs_review").otherwise("retry_strict").alias("action"), reason.alias("reason"))


def validate_pair(items: Column, expected: Column, sources: Column, lang: Column) -> Column:
    """"ok" for exactly two items of the expected indexes that all pass, "mismatch" or "poisoned" otherwise.

    ``items`` is an array of (chunkIndex, translation); of repeated indexes the later wins.
    """
    by_index = F.map_from_entries(F.transform(F.array_distinct(F.transform(items, lambda i: i["chunkIndex"])), lambda k: F.struct(k, F.element_at(F.filter(items, lambda i: i["chunkIndex"] == k), -1)["translation"])))
    texts = F.transform(expected, lambda k: F.element_at(by_index, k))
    bad = F.exists(F.arrays_zip(texts.alias("t"), sources.alias("s")), lambda p: (marker_count(p["t"]) > 0) | source_echo(p["s"], p["t"]) | wrong_language(p["t"], lang))
    return F.when((F.size(items) != 2) | F.exists(texts, lambda t: t.isNull()), "mismatch").when(bad, "poisoned").otherwise("ok")


def reject_reason(lang: Column, source: Column, output: Column, overall: Column) -> Column:
    """Why a plain reply is turned down: empty, echo, language checks, then the phases' verdict; null if it is not."""
    failures = language_qa(lang, source, output)["failures"]
    return F.when(trim_all(F.coalesce(output, F.lit(""))) == "", "empty").when((rules.rule(lang, "script") != "Latin") & looks_like_echo(output), "echo").when(F.size(failures) > 0, F.concat(F.lit("language:"), F.get(failures, F.lit(0)))).when(overall == "fail", "phases")


def baseline_suite(rolled: DataFrame, spot: DataFrame) -> DataFrame:
    """Suite totals from scores (unit_id, score, overall) and spot checks (unit_id, missing_names, script_issues)."""
    score = F.greatest(F.lit(0), F.col("score") - 8 * F.coalesce("missing_names", F.lit(0)) - 5 * F.coalesce("script_issues", F.lit(0)))
    rows = rolled.join(spot, "unit_id", "left").select("unit_id", score.alias("s"), F.when(score < 60, "fail").otherwise(F.col("overall")).alias("o"))
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("o") == o).alias(n) for o, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"))), round_half_up(F.avg("s")).cast("int").alias("average"))


def memory_of(hits: DataFrame) -> DataFrame:
    """First chunk of each (lang, term): a later chunk sees the form of the first, never its own.  ``hits``: lang, term, form, chunk_index."""
    return hits.groupBy("lang", "term").agg(F.min_by("form", "chunk_index").alias("form"), F.min("chunk_index").alias("first_chunk"))


def visible_memory(hits: DataFrame) -> DataFrame:
    """(lang, term, chunk_index, form): what each later chunk that holds a term sees of the chunk that had it first."""
    seen = hits.select("lang", "term", "chunk_index").distinct().join(memory_of(hits), ["lang", "term"])
    return seen.where(F.col("chunk_index") > F.col("first_chunk")).select("lang", "term", "chunk_index", "form")


def locked_terms(docs: DataFrame, terms: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Terms of the glossary that occur in texts and whose form differs, once a language and lower-cased source; the last wins."""
    changed = glossary(t=terms.where(F.col("source") != F.col("target")))
    found = with_hits(docs.select(id_col, "lang", F.col(text_col).alias("_text")), changed, "_text", [id_col])
    hits = found.select("lang", F.explode("hits").alias("h")).select("lang", "h.term", "h.form")
    return hits.groupBy("lang", F.lower("term").alias("key")).agg(F.max(F.struct("form", "term")).alias("t"), F.count(F.lit(1)).alias("texts")).select("lang", F.col("t.term").alias("source"), F.col("t.form").alias("target"), "texts")


def translate(fallbacks: Sequence[Column], names: Sequence[str]) -> Column:
    """(text, mode) of the first of several translations that is not null."""
    mode = F
    for column, name in zip(fallbacks, names, strict=True):
        mode = mode.when(column.isNotNull(), name)
    return F.struct(F.coalesce(*fallbacks).alias("text"), mode.alias("mode"))
