import corpus_pipeline
import pytest

from tessella.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    text = lambda k: " ".join(words[(k * 7 + j * (k % 11 + 1)) % 400] for j in range(60))
    rows = [(k, text(k) + (" vile rotten filth" if k % 5 == 0 else ""), "en", "s", 1) for k in range(200)]
    rows += [(300, rows[1][1] + " more", "en", "s", 1), (301, rows[2][1], "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0), (304, text(3) + " call me at ann@mail.example.com", "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), COLUMNS)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(k % 5 == 0 for k in kept["toxicity"] if k < 200) and len(kept["toxicity"]) == 165
    assert not {300, 301} & kept["near_duplicates"].keys() and {302, 303, 1, 2} <= kept["near_duplicates"].keys()
    assert "[EMAIL]" in kept["personal_data"].get(304, "[EMAIL]")
    packed = {i for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect() for i in r.doc_ids}
    assert packed == kept["personal_data"].keys()


def test_run_and_names(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.selectExpr("explode(doc_ids) AS i").distinct().count() >= 100
    assert packed.where("bin_id IS NOT NULL AND n_tokens > bin_capacity").count() == 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
