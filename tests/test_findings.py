"""Queries on small tables made for what a review found: odd sizes, and rows that a cut had left out."""

from hashlib import md5

import duckdb
import pytest

from tessella.plans import queries


@pytest.fixture
def compare(spark, tmp_path):
    """Rows of a query, from tables given as (rows, schema), once they equal those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = queries.queries()[name](spark, str(tmp_path))
        wanted = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in wanted.description]
        got, sql = sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(wanted.fetchall())
        assert got == sql
        return got

    return run


def test_chunk_pack_leaves_long_lines_whole(compare):
    long_line = " ".join(f"one two three four {k}." for k in range(600))
    texts = [(1, long_line), (2, f"a b\n{long_line}\nc d"), (3, f"{long_line}\n \n{long_line}"), (4, "a\nb"), (5, " \n")]
    assert compare("chunk_pack", documents=(texts, "doc_id long, text string")) == [(1, 1, 3000), (2, 3, 3004), (3, 2, 6000), (4, 1, 2)]


#: Texts of no part, of blank parts alone, and null.
BLANK_TEXTS = [(1, ""), (2, " "), (3, "\n"), (4, " \n\t\r\n \x0b\x0c"), (5, None)]


def test_boundary_assembly_has_no_row_without_a_part(compare):
    texts = [*BLANK_TEXTS, (6, "\n a \n \nb.\nc"), (7, "x"), (8, "слово\nдва"), (9, "He went.\u2028\nhome")]
    wanted = [(6, "a b.\n\nc"), (7, "x"), (8, "слово два"), (9, "He went.\u2028 home")]
    got = compare("boundary_assembly", documents=(texts, "doc_id long, text string"))
    assert got == [(i, md5(t.encode()).hexdigest()) for i, t in wanted]


def test_contract_assembly_has_no_row_without_a_part(compare):
    texts = [*BLANK_TEXTS, (6, "\n a \n \nb.\nc"), (7, "x")]
    got = compare("contract_assembly", documents=(texts, "doc_id long, text string"))
    assert got == [(i, md5(t.encode()).hexdigest()) for i, t in [(6, "a\n\nb.\n\nc"), (7, "x")]]


def test_pair_sections_gives_every_text_whole(compare):
    odd = [" a\n", "a <<<SECTION_A_END>>> b", "<<<SECTION_B_START>>>c<<<SECTION_B_END>>>", "<<<<SECTION# <<<SECTION##_A_END>>>\n<<<SECTION", "x<<<SECTION"]
    texts = [*BLANK_TEXTS, *enumerate(odd, 6)]
    got = compare("pair_sections", documents=(texts, "doc_id long, text string"))
    assert got == [(i, None if t is None else t.strip(" \t\n\r\f\x0b"), None) for i, t in texts]


def test_all_terminal_looks_at_every_job(compare):
    from datetime import datetime

    day = datetime(1995, 1, 1)
    # Projects 1 and 6 are complete and 11 has no job; an open job of any number keeps its project out.
    orders = [(1, 1, "1-URGENT", "F", day), (2, 1, "1-URGENT", "O", day), (4, 6, "2-HIGH", "F", day), (8, 16, "2-HIGH", "P", day), (10, 21, "5-LOW", "O", day), (12, 2, "5-LOW", "F", day)]
    customers = [(k, f"c{k}") for k in (1, 2, 6, 11, 16, 21)]
    got = compare("all_terminal", orders=(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp_ntz"), customer=(customers, "c_custkey long, c_name string"))
    assert got == [(6,), (11,)]


def test_quick_looks_change_no_result(spark):
    """Literals that are looked for first leave every text as its patterns alone would."""
    import random
    import re
    from functools import reduce

    from pyspark.sql import functions as F

    from tessella.functions import text as T

    rng = random.Random(3)
    token = r"(?i)_{0,4}[ \t]*PH[ \t]*[0-9OQIl]{1,3}[ \t]*_{1,4}|_{1,4}[ \t]*PH[ \t]*[0-9OQIl]{1,3}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])PH[ \t]*[0-9OQIl]{1,3}(?![A-Za-z0-9])"
    parts = ["Paragraph", "paragraph 3:", "[Paragraph #2]", "【 7 】", "[CHUNK 1]", "segment", "Sentence 4 -", "Output:", "translated text：", "final output :", "<<<A_B>>>", "Here's the translation", "Sure, here is x", "Note :", "note", "explanation:", "\n", "\n\n\n", " ", "*a*", "hell", "wine", "‎", "‏", "「", "。", "é", "ready to generate output.", "check QA rule: ", "here is the translation", "PH0_", "__PH0__", "phone", "PH 0", "graph"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    df, x = spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")
    plain = F.regexp_replace(reduce(lambda now, a: F.regexp_replace(now, a[1], a[2]), T.ARTIFACTS, x), r"\n{3,}", "\n\n")
    any_kind = reduce(lambda a, b: a | b, (x.rlike(p) for _, p, _ in T.ARTIFACTS))
    filtered = df.select(T.filter_artifacts(x).alias("a"), plain.alias("b"), T.has_artifacts(x).alias("c"), any_kind.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in filtered) and 50 < sum(r.c for r in filtered) < 390
    meta = T.trim_all(F.regexp_replace(reduce(lambda now, m: F.regexp_replace(now, m[1], ""), T._META, x), r"\n{3,}", "\n\n"))
    for r in df.select("t", T.restore_terms(x, F.array(F.lit("X"))).alias("r"), T.strip_meta(x, F.lit("fr")).alias("m"), meta.alias("n"), T.trim_all(x).alias("s"), T.is_blank(x).alias("b")).collect():
        assert r.m == r.n and r.s == r.t.strip(" \t\n\r\f\x0b") and r.b == (not r.s)
        assert re.search(token, r.t) or r.r == r.t
        assert "X" in r.r or not re.search(token, r.t)


def test_contexts_need_no_shuffle(spark):
    """A document's chunks see the one before them in their own row, so texts are dealt out to no other task."""
    from tessella.plans.translate import localize

    docs = spark.createDataFrame([(1, "One. Two. Three.\nFour five."), (1, "Six seven eight."), (2, None)], "doc_id long, text string")
    checked, _ = localize(docs, ["fr"], lambda p, s, lang: ("Previous text:\nTwo. Three.\n\n" if "Previous text:\nTwo. Three.\n\n" in p else "first: ") + s, most=3, separator="\n")
    assert sorted((r.project_id, r.chunk_index, r.reply) for r in checked.select("project_id", "chunk_index", "reply").collect()) == [(1, 0, "first: One. Two. Three."), (1, 0, "first: Six seven eight."), (1, 1, "Previous text:\nTwo. Three.\n\nFour five.")]
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_terms_meet_few_texts_at_once(spark):
    """Batches of texts for the term matcher are small, so a worker's memory does not follow the table."""
    from tessella.operators import quality

    table = spark.createDataFrame([("de", "river", "Fluss")], "lang string, source string, target string")
    pairs = spark.range(2_500).selectExpr("id AS unit_id", "'de' AS lang", "if(id % 2 = 0, 'a river', NULL) AS source", "'Fluss' AS output")
    found = quality.term_hits(pairs, table)
    assert sorted(map(tuple, found.groupBy("present", "matched", "status").count().collect())) == [(0, 0, "pass", 1250), (1, 1, "pass", 1250)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
