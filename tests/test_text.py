import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking, quality


def value(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def test_artifacts_go_and_prose_stays(spark):
    text = "【Paragraph 9】 The first.\nParagraph 3: The second.\nTranslation: The third.\n<<<PAIR_A_END>>> The paragraph about it."
    out = value(spark, T.filter_artifacts(F.col("t")), t=text)
    assert out == "\nThe first.\nThe second.\nThe third.\n The paragraph about it."
    kinds = [r.kind for r in value(spark, T.artifact_log(F.col("t")), t=text)]
    assert kinds == ["paragraph_label_bracketed", "paragraph_label_plain", "meta_label", "internal_marker"]


@pytest.mark.parametrize(("lang", "wanted"), [("ur", "“x”۔"), ("fr", "«x».") , ("ja", "「x」。"), ("zh", "「x」。"), ("xx", "“x”.")])
def test_punctuation_by_language(spark, lang, wanted):
    assert value(spark, T.normalize_punctuation(F.col("t"), F.col("l")), t="「x」。", l=lang) == wanted


@pytest.mark.parametrize(("parts", "wanted"), [(["He went", "home."], "He went home."), (["It ended.", "then more"], "It ended.\n\nthen more"), (["今日", "は"], "今日\n\nは"), ([" ", "a"], "a"), ([], "")])
def test_boundaries(spark, parts, wanted):
    assert value(spark, T.complete_boundaries(F.col("p")), p=parts) == wanted


def test_terms_are_locked_and_mangled_ones_restored(spark):
    locked = value(spark, T.lock_terms(F.col("t"), [("Anna", "Анна", True), ("river", "река", False), ("same", "same", False)]), t="Anna saw the River; anna and the same river.")
    assert locked.text == "__PH0__ saw the __PH1__; anna and the same __PH1__."
    out = value(spark, T.restore_terms(F.col("t"), F.array(*map(F.lit, locked.locked))), t="__PH0__ видит __ PH1 __, PHO и PH1; PH9 нет")
    assert out == "Анна видит река, Анна и река; PH9 нет"


def test_dictionary_becomes_prose(spark):
    text = "27.\nEnglish:\nThe war.\nUrdu:\nجنگ\n28.\nEnglish:\nIt ended.\nUrdu:\nختم"
    assert value(spark, T.dictionary_to_prose(F.col("t")), t=text) == "جنگ\n\nختم"
    assert value(spark, T.dictionary_to_prose(F.col("t")), t="plain") == "plain"


def test_rtl_runs_and_marks(spark):
    assert value(spark, T.reverse_rtl_runs(F.col("t")), t="ab ابت cd") == "ab تبا cd"
    assert value(spark, T.format_thought(F.col("t"), F.lit("ar")), t="a *b* c") == "a 【b】 c"
    assert value(spark, T.strip_meta(F.col("t"), F.lit("ur")), t="Ready to generate output.باب\nplain English line\n\nمتن") == "باب\n\nمتن"


@pytest.mark.parametrize(("text", "wanted"), [("", True), ("short", False), ("a long enough sentence in plain letters", True), ("une phrase assez longue avec des é", False)])
def test_echo(spark, text, wanted):
    assert value(spark, T.looks_like_echo(F.col("t")), t=text) is wanted


def test_cjk_and_arabic_word_counts(spark):
    assert value(spark, T.qa_word_count(F.col("t")), t="今日は良い天気です") == 4
    assert value(spark, T.qa_word_count(F.col("t")), t="،، one two ..") == 2


@pytest.mark.parametrize(
    ("lang", "source", "output", "failure"),
    [("ar", "the cat sat on the mat", "جلست القطة على الحصيرة هناك", None), ("ar", "the cat sat on the mat", "the cat sat on the mat", "script_ratio"), ("fr", "a b c", "", "empty"), ("ru", "one two three", "раз два три�", "replacement"), ("de", "one two three four", "ein", "length_ratio")],
)
def test_language_qa(spark, lang, source, output, failure):
    q = value(spark, quality.language_qa(F.col("l"), F.col("s"), F.col("o")), l=lang, s=source, o=output)
    assert (failure in q.failures) if failure else q.failures == []
    assert q.score == max(0, 100 - 20 * len(q.failures))


GOOD = '{"translation": "%s", "selfCheck": {"fullyTargetLanguage": true, "noMarkers": true, "completeSentences": true, "glossaryRespected": true}}'


@pytest.mark.parametrize(
    ("raw", "kind", "reason"),
    [
        ("", None, "empty_response"), ("no", None, "invalid_json"), ("[1]", None, "not_an_object"), ("{}", None, "single_missing_or_empty_translation"), ('{"translation": "x"}', None, "single_missing_selfCheck"),
        (GOOD.replace("true}}", '"true"}}') % "x", None, "single_selfCheck_glossaryRespected_not_boolean"), (GOOD % "x", "single", None), ('{"items": []}', None, "empty_items"), ('{"items": [%s]}' % (GOOD % "x"), "pair", None),
        ('{"items": [3]}', None, "pair_item_not_an_object"), ("```json\n{}\n```", None, "invalid_json"),
    ],
)
def test_contract(spark, raw, kind, reason):
    got = value(spark, quality.parse_contract(F.col("r")), r=raw)
    assert (got.kind, got.reason) == (kind, reason)


def test_verdicts(spark):
    none = F.array().cast("array<struct<source:string,target:string>>")
    verdict = lambda raw, lang="fr", locked=none, retried=False: tuple(value(spark, quality.validate_chunk(F.col("r"), F.lit(lang), F.lit("the source"), locked, F.lit(retried)), r=raw))
    assert verdict(GOOD % "Bonjour") == ("accept", None)
    assert verdict("x") == ("retry_strict", "invalid_json")
    assert verdict("x", retried=True) == ("needs_review", "invalid_json")
    assert verdict(GOOD.replace("true}}", "false}}") % "x") == ("retry_strict", "selfCheck_false:glossaryRespected")
    assert verdict(GOOD % "Translation: x") == ("retry_strict", "markers_detected:1")
    assert verdict(GOOD % "plain english words here", "ru") == ("retry_strict", "wrong_language:ru")
    assert verdict(GOOD % "x", locked=F.array(F.struct(F.lit("river").alias("source"), F.lit("fleuve").alias("target")))) == ("retry_strict", "glossary_missing:river")


def plain_pack(text, most):
    """The job's chunker, by hand."""
    import re

    words = lambda s: len(s.split())
    out, now, n = [], "", 0
    for p in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        if words(p) > most:
            if now:
                out.append(now)
            now, n, buf = "", 0, ""
            for s in re.split(r"(?<=[.!?])\s+", p):
                if buf and words(buf) + words(s) > most:
                    out.append(buf)
                    buf = s
                else:
                    buf = f"{buf} {s}" if buf else s
            if buf:
                out.append(buf)
        elif now and n + words(p) > most:
            out.append(now)
            now, n = p, words(p)
        else:
            now, n = (f"{now}\n\n{p}" if now else p), n + words(p)
    return [*out, now] if now else out


def test_chunks_equal_a_plain_packer(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "bb ", "c. ", "d! ", "\n\n", "\n\n\n", "e\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.chunk_paragraphs(F.col("t"), 5).alias("c")).collect()
    for r in got:
        assert r.c == plain_pack(texts[r.i], 5), texts[r.i]


def test_batch_chunks_keep_all_words(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "bb ", "c. ", "d! ", "\r\n\r\n", "\n\n"]) for _ in range(60)) for _ in range(100)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.chunk_paragraphs(F.col("t"), 5, variant="batch").alias("c")).collect():
        assert " ".join(r.c).split() == r.t.split()


def test_windows_pages_and_ranges(spark):
    text = " ".join(f"w{i}" + ("." if i % 9 == 8 else "") for i in range(50))
    got = value(spark, chunking.split_words(F.col("t"), 20), t=text)
    assert " ".join(got) == text and [len(w.split()) for w in got] == [18, 18, 14]
    pages = value(spark, chunking.chunk_pages(F.array(*map(F.lit, [3, 4, 9, 1, 1])), 8))
    assert [(r.first, r.last) for r in pages] == [(0, 1), (2, 2), (3, 4)]
    assert [(r.first, r.last) for r in value(spark, chunking.plan_batches(F.lit(120)))] == [(1, 50), (51, 100), (101, 120)]
    assert [(r.first, r.last) for r in value(spark, chunking.shrink_batch(F.lit(1), F.lit(50), F.lit(50)))] == [(1, 25), (26, 50)]
    assert value(spark, chunking.shrink_batch(F.lit(1), F.lit(10), F.lit(10))) is None
    assert value(spark, chunking.safe_pair_tokens(F.lit(8000), F.lit(8000), 60, 8000)) == 7218
    assert value(spark, chunking.safe_pair_tokens(F.lit(1200), F.lit(1200), 60, 800)) == 978
    assert [value(spark, chunking.backoff_ms(F.lit(a))) for a in (0, 3, 20)] == [2_000, 16_000, 120_000]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", max_size=12), max_size=5))
def test_assembly_keeps_words(spark, parts):
    out = value(spark, T.complete_boundaries(F.col("p")), p=parts)
    assert out.split() == " ".join(parts).split()


def test_glossaries_of_any_size_meet_texts_by_words(spark):
    pairs = spark.createDataFrame([(1, "fr", "The River and the old harbor.", "le fleuve"), (2, "fr", "Riverside.", ""), (3, "de", "a river, old", "der Fluss"), (4, "de", "a--b \u00e9tude", "\u00e9tude")], "unit_id int, lang string, source string, output string")
    terms = [("fr", "river", "fleuve"), ("fr", "old harbor", "vieux port"), ("de", "river", "Fluss"), ("de", "old harbor", "Hafen"), ("de", "--", "xx"), ("de", "lantern", None)]
    for more in (0, 3_000):
        table = spark.createDataFrame([*terms, *(("de", f"word{k} of", f"form{k}") for k in range(more))], "lang string, source string, target string")
        # A term without a word meets all texts of its language.
        assert sorted(map(tuple, quality.term_hits(pairs, table).collect())) == [(1, 2, 1, "warn"), (2, 0, 0, "pass"), (3, 1, 1, "pass"), (4, 1, 0, "fail")]
