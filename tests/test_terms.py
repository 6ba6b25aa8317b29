"""The term matcher against one pattern a term, in one automaton and in shards."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import quality
from tessella.operators.terms import Matcher, glossary, lowered, with_hits


def plain(rows, lang, text):
    """One pattern for each term; word characters and case are those of ASCII alone."""
    return sorted((tag, term, form or "") for tag, exact, own, term, form in rows if own == lang and text and re.search(rf"\b{re.escape(term if exact else lowered(term))}\b", text if exact else lowered(text), re.ASCII))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    letters = ["a", "b", "A", " ", "-", "é", "İ", "河", "_", "1"]
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    rows = [(rng.choice(["p1", "p9"]), False, rng.choice(["de", "ja"]), word(4), rng.choice([None, "x"])) for _ in range(120)]
    rows += [("p2", True, "de", word(3), "n") for _ in range(30)] + [("p1", False, "de", "ab", "y"), ("p9", False, "de", "ab", "y"), ("p2", True, "de", "Ab", "y")]
    texts = [(k, rng.choice(["de", "de", "de", "ja", "fr", None]), word(60)) for k in range(150)] + [(200, "de", None), (201, "de", ""), (202, "de", "Ab"), (203, "de", "ab")]
    return rows, texts


def test_matcher(case):
    rows, texts = case
    own = Matcher(rows)
    for _, lang, text in texts:
        assert sorted((h["tag"], h["term"], h["form"] or "") for h in own.find(lang, text)) == sorted(set(plain(rows, lang, text))) or len(set(rows)) < len(rows)


@pytest.mark.parametrize("most", [10_000, 40, 5])
def test_hits_of_all_tables(spark, case, most):
    rows, texts = case
    rows = sorted(set(rows), key=repr)
    table = lambda tag: spark.createDataFrame([(lang, term, form) for t, _, lang, term, form in rows if t == tag], "lang string, source string, target string")
    terms = glossary(p1=table("p1"), exact_p2=table("p2"), p9=table("p9"))
    df = spark.createDataFrame(texts, "id long, lang string, source string").repartition(3)
    got = {r.id: sorted((h.tag, h.term, h.form or "") for h in r.hits) for r in with_hits(df, terms, "source", ["id"], most=most, salts=3).collect()}
    assert got == {k: plain(rows, lang, text) for k, lang, text in texts}
    assert sum(map(len, got.values())) > 50


def test_names_are_exact(spark):
    table = spark.createDataFrame([("de", "Anna", "Anna"), ("fr", "Rose", None)], "lang string, source string, target string")
    pairs = spark.createDataFrame([(1, "de", "Anna ran.", "anna lief."), (2, "de", "Anna ran.", "Annas Lauf"), (3, "de", "anna ran", ""), (4, "fr", "Rose ran", "la Rose"), (4, "fr", "Rose ran", "Ros")], "unit_id long, lang string, source string, output string")
    assert sorted(map(tuple, quality.term_hits(pairs, table, exact=True).collect())) == [(1, 1, 0, "fail"), (2, 1, 1, "pass"), (3, 0, 0, "pass"), (4, 1, 0, "fail"), (4, 1, 1, "pass")]
    phases = {(r.unit_id, r.phase): r.status for r in quality.phase_checks(pairs.where("unit_id < 4"), table, names=table).collect()}
    assert phases[1, 1] == "pass" and phases[1, 2] == "fail" and phases[2, 2] == "pass" and len(phases) == 69
    plan = quality.phase_checks(pairs, table, table, table, table, table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
