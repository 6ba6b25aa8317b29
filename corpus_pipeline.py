"""A corpus on its way to training: five operators of ``tessella.llm`` in a row.

Each stage gets the documents that the one before kept, from Parquet, and all
but the last return the columns of ``documents``:

* toxicity drops documents that score as toxic;
* near duplicates: one document of each group stays;
* repeated passages lose all but their first occurrence;
* personal data is replaced by its kind in brackets;
* packing deals what is left into training sequences.

Null and empty texts pass every stage and get a row without a bin in the last;
of rows that repeat id and text each stays where a stage does not drop its
document; ties go to the smaller id; empty tables give empty results; extra
columns travel along until packing, whose result has columns of its own.

No SQL expresses these stages; ``tests/llm`` compares each operator with a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import hyperminhash, packing, pii, suffix_dedup, toxicity
from tessella.llm._shared import written

ORACLE_SQL = None
#: Words that a stage's workers remember, and rows of whole texts that travel to them together; few, as the
#: same workers serve all stages and hold on to what each has needed.
KEPT_WORDS, TOGETHER = 50_000, 1_000


def _few_rows(spark: SparkSession) -> None:
    """Smaller batches of texts for Python, unless the session has a size of its own."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) == 10_000:
        spark.conf.set(setting, str(TOGETHER))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on labels outside the held-out quarter."""
    _few_rows(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model.kept_words = KEPT_WORDS
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id; documents without words or id stay."""
    _few_rows(spark)
    return hyperminhash.keep_one(docs, kept_words=KEPT_WORDS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less passages of 100 bytes that an earlier one has."""
    _few_rows(spark)
    return _counted(suffix_dedup.drop_repeats(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data as its kind in brackets."""
    _few_rows(spark)
    model = pii.fit(docs)
    return _counted(docs.withColumn("text", pii.redacted(model, F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of permitted lengths; texts without tokens get a row with no bin."""
    import public_tokenizers

    _few_rows(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, kept_words=KEPT_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
