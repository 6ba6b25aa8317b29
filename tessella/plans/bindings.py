"""The library's inputs as views of the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.documents import load

LANGS = ["ar", "de", "es", "fr", "ru"]
#: The fixed "now" of reports over orders, in ms: 1998-09-01.
NOW = 904_608_000_000


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: customer as project, priority as language, order as chunk."""
    o = load(spark, sf_dir, "orders")
    k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    lang = F.when(first == "1", "ar").when(first == "2", "de").when(first == "3", "es").when(first == "4", "fr").otherwise("ru")
    status = F.when(F.col("o_orderstatus") == "F", F.when(k % 10 == 3, "failed").otherwise("done")).when(F.col("o_orderstatus") == "O", F.when(k % 7 == 0, "claimed").when(k % 11 == 0, "needs_review").otherwise("pending")).otherwise("retry_wait")
    created = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    rows = o.select(F.col("o_custkey").alias("project_id"), lang.alias("lang"), k.alias("chunk_index"), status.alias("status"), created.alias("created_at"))
    claimed = F.col("created_at") + (F.col("chunk_index") % 300) * 1000
    return rows.select(
        "*", claimed.alias("claimed_at"), F.when(F.col("status") == "done", claimed + (F.col("chunk_index") % 997) * 1000).alias("completed_at"),
        F.when((F.col("status") == "claimed") & (F.col("chunk_index") % 2 == 1), F.col("created_at")).alias("heartbeat_at"), F.when(F.col("status") == "retry_wait", F.col("created_at") + 86_400_000).alias("next_retry_at"),
    )


JOBS = """jobs0 AS (
  SELECT o_custkey AS project_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ar' WHEN '2' THEN 'de' WHEN '3' THEN 'es' WHEN '4' THEN 'fr' ELSE 'ru' END AS lang, o_orderkey AS chunk_index,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 3 THEN 'failed' ELSE 'done' END WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'claimed' WHEN o_orderkey % 11 = 0 THEN 'needs_review' ELSE 'pending' END ELSE 'retry_wait' END AS status,
    epoch_ms(o_orderdate) AS created_at FROM orders
), jobs AS (
  SELECT *, created_at + (chunk_index % 300) * 1000 AS claimed_at, CASE WHEN status = 'done' THEN created_at + (chunk_index % 300) * 1000 + (chunk_index % 997) * 1000 END AS completed_at,
    CASE WHEN status = 'claimed' AND chunk_index % 2 = 1 THEN created_at END AS heartbeat_at, CASE WHEN status = 'retry_wait' THEN created_at + 86400000 END AS next_retry_at FROM jobs0
)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects."""
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, "complete").otherwise("translating").cast("string").alias("status"))


PROJECTS = "projects AS (SELECT c_custkey AS project_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'complete' ELSE 'translating' END AS status FROM customer)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn as (source, output); languages by conversation."""
    c = load(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    lang = F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "ru", "ja"])), (F.col("conv_id") % 5 + 1).cast("int"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), lang.alias("lang"), "source", "output")


PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS unit_id, CASE u.conv_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'ru' ELSE 'ja' END AS lang, u.text AS source, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source as project, order of ids as index."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project_id"), "lang", F.col("doc_id").alias("chunk_index"), "text", F.when(F.col("doc_id") % 6 == 5, "pending").otherwise("done").alias("status"), F.length("text").alias("n_chars"))


CHUNKS = "chunks AS (SELECT source AS project_id, lang, doc_id AS chunk_index, text, CASE WHEN doc_id % 6 = 5 THEN 'pending' ELSE 'done' END AS status, length(text) AS n_chars FROM documents)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of projects."""
    e = load(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(F.col("user_id").alias("project_id"), "event_id", "event_type", us.alias("ts_us"), F.floor(us / 1000).alias("ts_ms"), "ts", "value", "props")


REQUESTS = "requests AS (SELECT user_id AS project_id, event_id, event_type, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms, ts, value, props FROM events)"
