"""Text functions on columns: counting, cleaning, joining, marking.

All of them are built-in expressions, so they stay inside one projection.
Classes are spelled out in ASCII where engines differ on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.rules import AVOID, EXPLICIT, LATIN_TARGETS, NAMES, RTL, SCRIPTS, per_language, rule

SPACE = r"[ \t\n\r\f\x0B]"
_BLANKS = " \t\n\r\f\x0b"


def once(value: Column, step) -> Column:
    """``step(value)``, with the value made once however often the step names it (as an array of one)."""
    return F.transform(F.array(value), step)[0]


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def regexp_total(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def qa_word_count(text: Column) -> Column:
    """Words, estimated from characters where the script does not part words by spaces."""
    cleaned = F.regexp_replace(text, r"[​-‏‪-‮⁦-⁩﻿]", "")
    cleaned = F.regexp_replace(cleaned, rf"^(?:{SPACE}|\p{{P}})+|(?:{SPACE}|\p{{P}})+$", "")
    spaced = word_count(cleaned)
    arabic = regexp_total(cleaned, r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")
    cjk = regexp_total(cleaned, r"[　-〿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ가-힯]")
    return (
        F.when(arabic > 50, F.greatest(spaced, round_half_up(arabic / 8).cast("int")))
        .when(cjk > 0, F.greatest(spaced, round_half_up(cjk / F.lit(2.5)).cast("int"))).otherwise(spaced)
    )


def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?。！？]){SPACE}+")


def holds(low: Column, *words: str) -> Column:
    """Whether a lower-cased text has any of some literals: a cheap look before a costly pattern."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


#: kind, pattern and what takes its place (fixed values; the internal marker is any upper-case name in angle brackets).
ARTIFACTS = [
    ("paragraph_label_bracketed", rf"(?i){SPACE}*[【\[]{SPACE}*Paragraph(?:{SPACE}*#?{SPACE}*[0-9]+)?{SPACE}*[】\]]{SPACE}*", "\n"),
    ("paragraph_label_plain", rf"(?i)(?:^|\n){SPACE}*Paragraph{SPACE}*#?{SPACE}*[0-9]+{SPACE}*[:\-—]{SPACE}*", "\n"),
    ("sentence_label", rf"(?i)(?:^|\n){SPACE}*Sentence{SPACE}*#?{SPACE}*[0-9]+{SPACE}*[:\-—]{SPACE}*", "\n"),
    ("meta_label", rf"(?i)(?:^|\n){SPACE}*(?:Translation|Output|Translated{SPACE}+text|Result|Final{SPACE}+(?:translation|output)){SPACE}*[:：]{SPACE}*", "\n"),
    ("internal_marker", rf"<<<{SPACE}*[A-Z]+_[A-Z_]+{SPACE}*>>>?", ""),
    ("model_commentary", rf"(?i)(?:^|\n){SPACE}*(?:Here(?:'s| is) (?:the )?(?:translation|your translation)|Sure,? here(?:'s| is)[^:\n]*|Note{SPACE}*:|Explanation{SPACE}*:){SPACE}*", ""),
    ("numbered_cjk_bracket", rf"{SPACE}*【{SPACE}*[0-9]{{1,3}}{SPACE}*】{SPACE}*", "\n"),
    ("chunk_label", rf"(?i){SPACE}*[【\[]{SPACE}*(?:Chunk|Segment|Part){SPACE}*#?{SPACE}*[0-9]+{SPACE}*[】\]]{SPACE}*", "\n"),
]


#: What a text must hold, in lower case, for a kind's pattern to match: one literal of each group.
_NEEDED = {
    "paragraph_label_bracketed": [("【", "["), ("paragraph",)], "paragraph_label_plain": [("paragraph",)], "sentence_label": [("sentence",)],
    "meta_label": [(":", "："), ("translation", "output", "translated", "result", "final")], "internal_marker": [("<<<",)],
    "model_commentary": [("translation", "sure", "note", "explanation"), (":", "translation", "here")],
    "numbered_cjk_bracket": [("【",)], "chunk_label": [("【", "["), ("chunk", "segment", "part")],
}


def filter_artifacts(text: Column) -> Column:
    """The text without artifacts, kind by kind: a kind finds what earlier ones have left."""
    # A text that no kind matches as it comes is left alone by all of them.
    out = once(text, lambda t: F.when(has_artifacts(t), reduce(lambda now, a: F.regexp_replace(now, a[1], a[2]), ARTIFACTS, t)).otherwise(t))
    return _few_breaks(out)


def _log_step(kind: str, pattern: str, instead: str):
    def sample(m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.substring(trim_all(m), 1, 40).alias("sample"))

    def step(s: Column) -> Column:
        found = F.concat(s["log"], F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), sample))
        return F.when(s["text"].rlike(pattern), F.struct(F.regexp_replace(s["text"], pattern, instead).alias("text"), found.alias("log"))).otherwise(s)

    return step


def artifact_log(text: Column) -> Column:
    """Array of (kind, sample) of what ``filter_artifacts`` takes out."""
    state = F.struct(text.alias("text"), F.array().cast("array<struct<kind:string,sample:string>>").alias("log"))
    for artifact in ARTIFACTS:
        # A struct is kept as an array of one between steps: each step names it once.
        state = F.transform(F.array(state), _log_step(*artifact))[0]
    return F.filter(state["log"], lambda m: m["sample"] != "")


def has_artifacts(text: Column) -> Column:
    """Whether the log would hold anything: the first kind to match sees the text as it came, so that test is enough."""

    def met(low: Column, kind: str, pattern: str) -> Column:
        return reduce(lambda a, b: a & b, (holds(low, *words) for words in _NEEDED[kind])) & text.rlike(pattern)

    return once(F.lower(text), lambda low: reduce(lambda a, b: a | b, (met(low, kind, pattern) for kind, pattern, _ in ARTIFACTS)))


def normalize_punctuation(text: Column, lang: Column) -> Column:
    def build(plain: Column, r: tuple) -> Column:
        return plain if r[3] else F.translate(plain, "「『」』【】〔〕。、", f"{r[1]}{r[1]}{r[2]}{r[2]}()(){r[4][0]},")

    # Texts of ASCII alone have nothing to change, and are told by their length in bytes.
    odd = lambda t: (F.octet_length(t) > F.length(t)) & t.rlike("[「『」』【】〔〕。、]")
    return once(without_marks(text), lambda t: F.when(odd(t), per_language(lang, lambda r: build(t, r))).otherwise(t))


def without_marks(text: Column) -> Column:
    """The text without marks of direction."""
    return F.replace(F.replace(text, F.lit("\u200e"), F.lit("")), F.lit("\u200f"), F.lit(""))


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE[1:]}")


#: Scripts whose parts are never joined, whatever their case.
APART = r"[؀-ۿऀ-ॿঀ-৿Ѐ-ӿ぀-ヿ一-鿿]"


def joins_sentence(before: Column, after: Column, apart: str | None = APART) -> Column:
    """Whether a break between two parts cuts a sentence: no end before it, a small letter of a script not kept apart after it."""
    first = F.substring(after, 1, 1)
    cased = (F.lower(first) == first) & (F.upper(first) != first)
    # ``\z``, as ``$`` would look past a last line separator.
    return ~before.rlike(r"[.!?…]\z") & (cased & ~first.rlike(apart) if apart else cased)


def complete_boundaries(parts: Column, apart: str | None = APART) -> Column:
    """Parts in order as one text: a space where a sentence goes on, else a blank line; blank parts are left out."""
    own = F.filter(F.transform(parts, trim_all), lambda p: p != "")

    # Only neighbours matter: each part but the first gets its joiner, and all are joined once.
    def joined(own: Column) -> Column:
        rest = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
        before = F.slice(own, F.lit(1), F.size(rest))
        return F.array_join(F.concat(F.slice(own, 1, 1), F.zip_with(before, rest, lambda b, p: F.concat(F.when(joins_sentence(b, p, apart), " ").otherwise("\n\n"), p))), "")

    return once(own, joined)


def assemble(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, trim_all), lambda p: p != ""), "\n\n")


#: Patterns of remarks about the work, each with a word that it needs.
_META = [
    ("generate", rf"(?i)\bready{SPACE}+to{SPACE}+generate{SPACE}+(?:the{SPACE}+)?output{SPACE}*[.!:]*{SPACE}*"), ("rule", rf"(?i)\bcheck(?:ing)?{SPACE}+qa{SPACE}+rules?{SPACE}*:{SPACE}*"),
    ("translated", rf"(?i)\boutput{SPACE}+only{SPACE}+the{SPACE}+translated{SPACE}+text{SPACE}*[.!:]*{SPACE}*"), ("translation", rf"(?im)^{SPACE}*here(?:'s|{SPACE}+is){SPACE}+(?:the{SPACE}+)?translation{SPACE}*[.!:]*{SPACE}*"),
]


def strip_meta(text: Column, lang: Column) -> Column:
    # The words are looked for in the text as it comes: where none is there, no pattern changes it.
    out = once(text, lambda t: F.when(holds(F.lower(t), *(word for word, _ in _META)), reduce(lambda now, m: F.regexp_replace(now, m[1], ""), _META, t)).otherwise(t))

    def foreign(line: Column) -> Column:
        return once(trim_all(line), lambda own: (own == "") | (F.length(F.regexp_replace(own, "[^A-Za-z]+", "")) * 2 < F.length(own)))

    def kept(t: Column) -> Column:
        return F.when(rule(lang, "script") == "Latin", t).otherwise(F.array_join(F.filter(F.split(t, "\n"), foreign), "\n"))

    return trim_all(_few_breaks(once(out, kept)))


def _few_breaks(text: Column) -> Column:
    return once(text, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t))


def strip_code_fence(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(text, rf"(?i)^```(?:json|markdown|text)?{SPACE}*", ""), rf"{SPACE}*```{SPACE}*$", ""))


def extract_section(raw: Column, letter: str) -> Column:
    body = F.regexp_extract(raw, rf"(?s)<<<SECTION_{letter}_START>>>(.*?)<<<SECTION_{letter}_END>>>", 1)
    return F.nullif(trim_all(body), F.lit(""))


def looks_like_echo(text: Column) -> Column:
    """Blank, or at least 20 letters that are all ASCII."""
    letters, ascii_ = regexp_total(text, r"\p{L}"), regexp_total(text, "[A-Za-z]")
    return (trim_all(text) == "") | ((letters >= 20) & (letters == ascii_))


#: market, rule, pattern, replacement, languages (None: all); applied in this order.  Ours, and neutral.
MARKET_RULES = [
    ("standard", "mild", r"(?i)\bdamn\b", "blast", None), ("standard", "mild", r"(?i)\bhell\b", "heck", None), ("family", "mild", r"(?i)\b(?:damn|hell)\b", "oh", None),
    ("family", "drink", r"(?i)\b(?:wine|beer)\b", "juice", None), ("conservative", "drink", r"(?i)\b(?:wine|beer)\b", "tea", ["ar", "ur", "ks"]),
]
#: A text without any of these is changed by none of the rules.
_MARKET_WORDS = ("damn", "hell", "wine", "beer")


def cultural_filter(text: Column, lang: Column, market: str, compat: bool = False) -> Column:
    """A market's rules in order.  ``compat`` changes nothing, as the rules never matched there."""
    def ruled(out: Column) -> Column:
        for name, _, pattern, instead, langs in MARKET_RULES:
            if name == market:
                done = F.regexp_replace(out, pattern, instead)
                out = done if langs is None else F.when(lang.isin(langs), done).otherwise(out)
        return out

    return text if compat else once(text, lambda t: F.when(holds(F.lower(t), *_MARKET_WORDS), ruled(t)).otherwise(t))


def format_thought(text: Column, lang: Column) -> Column:
    marked = F.when(lang.isin(RTL), F.regexp_replace(text, r"\*([^*]+)\*", "【$1】")).otherwise(F.regexp_replace(text, r"\*([^*]+)\*", "「$1」"))
    return F.when(F.contains(text, F.lit("*")), marked).otherwise(text)


def format_quote(text: Column, lang: Column) -> Column:
    return F.concat(rule(lang, "quote_open"), text, rule(lang, "quote_close"))


def format_dialogue(speaker: Column, text: Column, lang: Column) -> Column:
    return F.when(lang.isin("ja", "zh"), F.concat(speaker, F.lit("「"), text, F.lit("」"))).otherwise(F.concat(speaker, F.lit(": "), format_quote(text, lang)))


def format_ellipsis(text: Column, lang: Column) -> Column:
    return F.concat(text, F.when(lang.isin("ja", "zh"), "……").otherwise("…"))


def format_dash(text: Column, lang: Column) -> Column:
    return F.concat(text, F.lit(" "), F.when(lang.isin("ja", "zh"), "——").otherwise("—"))


def reverse_rtl_runs(text: Column) -> Column:
    letters = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
    runs = F.regexp_extract_all(text, F.lit(rf"[{letters}]+|[^{letters}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{letters}]"), F.reverse(r)).otherwise(r)), "")


def reverse_words(text: Column) -> Column:
    return F.array_join(F.reverse(word_list(text)), " ")


def preserve_line_breaks(original: Column, translated: Column) -> Column:
    """Words of the translation dealt into the original's lines by their word counts; what is over is dropped."""
    lines = F.transform(F.split(original, "\n"), word_count)
    # The fold handles numbers alone; words are cut once a line.
    ends = once(lines, lambda n: F.aggregate(n, F.struct(F.array().cast("array<int>").alias("e"), F.lit(0).alias("at")), lambda a, x: F.struct(F.array_append(a["e"], a["at"] + x).alias("e"), (a["at"] + x).alias("at")))["e"])

    def deal(words: Column) -> Column:
        return once(F.struct(lines.alias("n"), ends.alias("e")), lambda m: F.array_join(F.zip_with(m["n"], m["e"], lambda n, e: F.array_join(F.slice(words, e - n + 1, n), " ")), "\n"))

    return once(F.split(translated, rf"{SPACE}+"), deal)


def _any_word(words: Sequence[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def detect_explicit(text: Column) -> Column:
    return text.rlike(_any_word(EXPLICIT))


def profanities(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, AVOID)), lambda w: F.array_contains(latin_words(text), w))


def detect_script(text: Column) -> Column:
    return reduce(lambda out, s: out.when(text.rlike(s[1]), s[0]), SCRIPTS, F).otherwise(F.lit(None).cast("string"))


def detect_characters(text: Column, names: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(text, n))


def count_occurrences(text: Column, needle: str) -> Column:
    if not needle:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(F.lower(text), F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("int")


def latin_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+(?:['’-][A-Za-z]+)*"), F.lit(0)), F.lower)


def is_latin_target(lang: Column) -> Column:
    return lang.isin(LATIN_TARGETS)


def is_script_language(lang: Column) -> Column:
    return rule(lang, "script") != "Latin"


def speaker_line(text: Column) -> Column:
    pattern = r'^([A-Z][A-Za-z ]*): ?["“«](.*)["”»]$'
    said = F.regexp_extract(text, pattern, 2)
    mood = F.when(F.endswith(said, F.lit("!")), "excited").when(F.endswith(said, F.lit("?")), "curious").when(F.endswith(said, F.lit("...")), "hesitant").otherwise("neutral")
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), said.alias("line"), mood.alias("mood")))


def glossary_swap(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda out, t: F.regexp_replace(out, rf"(?i)\b{t[0]}\b", t[1]), terms, text)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_.-]", "_")


def job_key(project: Column, lang: Column, index: Column, kind: str = "") -> Column:
    return F.concat_ws(":", project.cast("string"), lang, *([F.lit(kind)] if kind else []), index.cast("string"))


def symbols(source: Column) -> Column:
    """Names that a script exports, and modules that it imports."""
    return F.struct(
        F.regexp_extract_all(source, F.lit(r"export (?:default )?(?:async )?(?:function|const|class|type|interface) ([A-Za-z0-9_]+)"), F.lit(1)).alias("exports"),
        F.regexp_extract_all(source, F.lit(r"""import[^'"]*['"]([^'"]+)['"]"""), F.lit(1)).alias("imports"),
    )


def _lock(pattern: str, form: str):
    def step(s: Column) -> Column:
        token = F.concat(F.lit("__PH"), F.size(s["locked"]).cast("string"), F.lit("__"))
        return F.when(s["text"].rlike(pattern), F.struct(F.regexp_replace(s["text"], F.lit(pattern), token).alias("text"), F.array_append(s["locked"], F.lit(form)).alias("locked"))).otherwise(s)

    return step


def lock_terms(text: Column, terms: Sequence[tuple[str, str, bool]]) -> Column:
    """(text, locked): each term that occurs becomes the next ``__PHn__``; locked holds the forms in that order.

    ``terms`` are (source, form, case_sensitive), in order; a form equal to its
    term is skipped unless the term is a name.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("locked"))
    for source, form, exact in terms:
        if not exact and source == form:
            continue
        pattern = rf"{'' if exact else '(?i)'}\b\Q{source}\E\b"
        # A struct is kept as an array of one between steps: each step names it once.
        state = F.transform(F.array(state), _lock(pattern, form))[0]
    return state


def restore_terms(text: Column, locked: Column) -> Column:
    """Placeholders, also mangled ones (spaces, lost underscores, O or Q for 0, l for 1), as their forms again."""
    token = r"(?i)_{0,4}[ \t]*PH[ \t]*([0-9OQIl]{1,3})[ \t]*_{1,4}|_{1,4}[ \t]*PH[ \t]*([0-9OQIl]{1,3})(?![A-Za-z0-9])|(?<![A-Za-z0-9_])PH[ \t]*([0-9OQIl]{1,3})(?![A-Za-z0-9])"
    # Parts between tokens and tokens alternate; each token is looked up by its number.
    parts, tokens = F.split(text, token, -1), F.regexp_extract_all(text, F.lit(token), F.lit(0))
    number = lambda t: F.translate(F.regexp_replace(F.regexp_replace(t, r"(?i)^[_ \t]*PH", ""), r"[_ \t]", ""), "OQoqIil", "0000111").cast("int")
    restored = F.array_join(F.concat(F.array(parts[0]), F.flatten(F.zip_with(tokens, F.slice(parts, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda t, p: F.array(F.coalesce(F.get(locked, number(t)), t), F.coalesce(p, F.lit("")))))), "")
    # Every form of a token has this at its heart, and few texts do.
    return F.when(text.rlike(r"(?i)PH[ \t]*[0-9OQIl]{1,3}(?:[ \t]*_|(?![A-Za-z0-9]))"), restored).otherwise(text)


#: Heads of a target side: a language's name, or a word for one.
_LABELS = "|".join([*(name for lang, name in NAMES.items() if lang != "en"), "Target", "Translation"])


def dictionary_to_prose(text: Column) -> Column:
    """Target sides of numbered source and target blocks; other texts stay."""
    numbered = holds(F.lower(text), "english", "source") & text.rlike(rf"(?i)(?:^|\n){SPACE}*[0-9]+{SPACE}*\.{SPACE}*\n{SPACE}*(?:English|Source){SPACE}*:{SPACE}*\n") & text.rlike(rf"(?i)(?:^|\n){SPACE}*(?:{_LABELS}){SPACE}*:{SPACE}*\n")
    start = F.struct(F.array().cast("array<string>").alias("values"), F.lit("").alias("held"), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        target = line.rlike(rf"(?i)^{SPACE}*(?:{_LABELS}){SPACE}*:{SPACE}*$")
        other = line.rlike(rf"(?i)^{SPACE}*(?:(?:English|Source){SPACE}*:|[0-9]+{SPACE}*\.){SPACE}*$")
        value = trim_all(acc["held"])
        flushed = F.when(value != "", F.array_append(acc["values"], value)).otherwise(acc["values"])
        return F.when(target | other, F.struct(flushed.alias("values"), F.lit("").alias("held"), target.alias("inside"))).otherwise(F.struct(acc["values"].alias("values"), F.when(acc["inside"], F.concat(acc["held"], F.lit("\n"), line)).otherwise(acc["held"]).alias("held"), acc["inside"].alias("inside")))

    folded = F.aggregate(F.concat(F.split(text, "\n"), F.array(F.lit("0."))), start, step)["values"]
    return F.when(numbered & (F.size(folded) > 0), F.array_join(folded, "\n\n")).otherwise(text)


def post_process(text: Column, lang: Column, locked: Column, market: str = "standard", compat: bool = False) -> Column:
    """A reply on its way to a chunk: restore, unfold, strip, filter, normalise, mark."""
    out = once(restore_terms(text, locked), dictionary_to_prose)
    out = once(out, lambda t: strip_meta(t, lang))
    out = once(F.regexp_replace(out, rf"(?i)^{SPACE}*(?:translation|translated text){SPACE}*:{SPACE}*", ""), filter_artifacts)
    out = once(out, lambda t: cultural_filter(normalize_punctuation(t, lang), lang, market, compat))
    out = once(out, lambda t: format_thought(t, lang))
    return once(out, lambda t: trim_all(F.when(lang.isin(RTL) & ~t.startswith("‏"), F.concat(F.lit("‏"), t)).otherwise(t)))


def prompt(lang: Column, text: Column, context: Column, strict: bool = False) -> Column:
    """Instructions for a translator, from the language's rules; ``context`` (may be null) is what came before."""
    rules = F.concat_ws("\n", F.concat(F.lit("Target language: "), lang), F.concat(F.lit("Quotes: "), rule(lang, "quote_open"), rule(lang, "quote_close")), F.concat(F.lit("Direction: "), rule(lang, "direction")), F.concat(F.lit("Dash: "), rule(lang, "dash")))
    before = F.when(context.isNotNull(), F.concat(F.lit("Previous text:\n"), context))
    return F.concat_ws("\n\n", rules, before, F.concat(F.lit("Translate:\n"), text), F.lit("Reply with the translation alone, as one JSON object.") if strict else F.lit("Reply with the translation alone."))
