"""Per-language rules as plain tables: small dimensions that jobs look up or join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARABIC, CYRILLIC, DEVANAGARI, BENGALI = r"؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿", r"Ѐ-ӿ", r"ऀ-ॿ", r"ঀ-৿"
LATIN, EXTENDED = "A-Za-z", r"A-Za-zÀ-ɏ"

# Lang, opening and closing quote, CJK brackets are native, sentence ends, direction, script class, script, dash.
RULES = [
    ("ar", "«", "»", False, "۔.!?", "rtl", ARABIC, "Arabic", "—"),
    ("bn", "“", "”", False, "।॥.!?", "ltr", BENGALI, "Bengali", "—"),
    ("de", "„", "“", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("en", "“", "”", False, ".!?…", "ltr", LATIN, "Latin", "—"),
    ("es", "«", "»", False, ".!?¡…", "ltr", EXTENDED, "Latin", "—"),
    ("fa", "«", "»", False, "۔.!?", "rtl", r"؀-ۿﭐ-﷿ﹰ-﻿", "Arabic", "—"),
    ("fr", "«", "»", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("hi", "“", "”", False, "।॥.!?", "ltr", DEVANAGARI, "Devanagari", "—"),
    ("id", "“", "”", False, ".!?…", "ltr", LATIN, "Latin", "—"),
    ("it", "«", "»", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("ja", "「", "」", True, "。!?", "ltr", r"぀-ヿ一-鿿！-ﾟ", "Japanese", "―"),
    ("ko", "“", "”", False, ".!?", "ltr", r"가-힯ᄀ-ᇿ", "Hangul", "—"),
    ("ks", "“", "”", False, "۔!?", "rtl", r"؀-ۿऀ-ॿ", "Arabic", "—"),
    ("la", "“", "”", False, ".!?", "ltr", LATIN, "Latin", "—"),
    ("ne", "“", "”", False, "।॥.!?", "ltr", DEVANAGARI, "Devanagari", "—"),
    ("pt", "“", "”", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("ro", "„", "”", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("ru", "«", "»", False, ".!?…", "ltr", CYRILLIC, "Cyrillic", "—"),
    ("sw", "“", "”", False, ".!?…", "ltr", LATIN, "Latin", "—"),
    ("tr", "“", "”", False, ".!?…", "ltr", EXTENDED, "Latin", "—"),
    ("ur", "“", "”", False, "۔!?", "rtl", ARABIC, "Arabic", "—"),
    ("zh", "“", "”", True, "。!?", "ltr", r"一-鿿　-〿＀-￯", "Chinese", "—"),
]
FIELDS = "lang string, quote_open string, quote_close string, cjk_native boolean, sentence_end string, direction string, script_class string, script string, dash string"
BY_LANG = {r[0]: r for r in RULES}
LATIN_TARGETS = [r[0] for r in RULES if r[7] == "Latin" and r[0] != "en"]
RTL = ["ar", "ur", "ks"]

# Ranges by which the script of a text is told, first match wins.
SCRIPTS = [
    ("Arabic script", r"[؀-ۿݐ-ݿࢠ-ࣿ]"), ("CJK/Japanese script", r"[぀-ヿ㐀-鿿]"), ("Cyrillic script", r"[Ѐ-ӿ]"),
    ("Hangul script", r"[가-힯]"), ("Devanagari script", r"[ऀ-ॿ]"), ("Bengali script", r"[ঀ-৿]"),
]
# Ranges by which a translation is held to its target script.
TARGET_SCRIPTS = {
    "ar": r"؀-ۿݐ-ݿ", "ur": r"؀-ۿݐ-ݿ", "ks": r"؀-ۿݐ-ݿ", "fa": r"؀-ۿ", "hi": r"ऀ-ॿ", "ne": r"ऀ-ॿ",
    "bn": r"ঀ-৿", "ja": r"぀-ヿ一-鿿", "ko": r"가-힯ᄀ-ᇿ", "zh": r"一-鿿", "ru": r"Ѐ-ӿ",
}

#: Our own neutral terms: a small glossary with forms per language, names, ranks and words to avoid.
TERMS = [
    ("de", "river", "Fluss"), ("de", "market", "Markt"), ("de", "harbor", "Hafen"), ("de", "bridge", "Brücke"), ("fr", "river", "rivière"), ("fr", "market", "marché"), ("fr", "harbor", "port"),
    ("fr", "bridge", "pont"), ("es", "river", "río"), ("es", "market", "mercado"), ("es", "harbor", "puerto"), ("es", "bridge", "puente"),
]
AVOID = ["damn", "hell", "bastard", "crap"]
EXPLICIT = ["explicit", "intimate scene", "nude", "graphic violence", "gore", "torture", "slur", "drunken"]
#: Our own small tables of people, ranks and core terms: lang, term, form (null where a language has none).
PEOPLE = [("de", "Anna", "Anna"), ("fr", "Anna", "Anna"), ("es", "Anna", "Ana"), ("ru", "Anna", "Анна"), ("ja", "Anna", "アンナ")]
RANKS = [("de", "captain", "Hauptmann"), ("fr", "captain", "capitaine"), ("es", "captain", "capitán"), ("ru", "captain", "капитан"), ("ja", "captain", None)]
CORE_TERMS = [("de", "lantern", "Laterne"), ("fr", "lantern", "lanterne"), ("es", "lantern", "farol"), ("ru", "lantern", None)]
# Words that mark a chapter's heading.
CHAPTER_WORDS = ["chapter", "الفصل", "глава", "第", "章", "장", "पाठ", "অধ্যায়", "kapitel", "chapitre", "capítulo", "capitolo", "capitol", "bölüm", "bab", "فصل", "अध्याय", "अनुच्छेद"]
#: English names of the languages, as labels of translations carry them.
NAMES = {
    "ar": "Arabic", "bn": "Bangla", "de": "German", "en": "English", "es": "Spanish", "fa": "Persian", "fr": "French", "hi": "Hindi", "id": "Indonesian", "it": "Italian", "ja": "Japanese",
    "ko": "Korean", "ks": "Kashmiri", "la": "Latin", "ne": "Nepali", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sw": "Swahili", "tr": "Turkish", "ur": "Urdu", "zh": "Chinese",
}


def language_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, FIELDS)


def rule(lang: Column, field: str) -> Column:
    """A rule of a row's language; unknown languages take that of English."""
    at = [f.split()[0] for f in FIELDS.split(", ")].index(field)
    groups: dict = {}
    for r in RULES:
        groups.setdefault(r[at], []).append(r[0])
    out = F
    for value, langs in groups.items():
        if value != BY_LANG["en"][at]:
            out = out.when(lang.isin(langs), F.lit(value))
    return out.otherwise(F.lit(BY_LANG["en"][at])) if out is not F else F.lit(BY_LANG["en"][at])


def per_language(lang: Column, build) -> Column:
    """``build(rule row)`` for each language, chosen by a row's language."""
    out = F
    for r in RULES:
        if r[0] != "en":
            out = out.when(lang == r[0], build(r))
    return out.otherwise(build(BY_LANG["en"]))
