"""Reports over jobs, chunks and translations: counts, progress, gates, upserts.

Every function takes DataFrames in the library's terms (project_id, lang,
chunk_index, status, ...) and the time as an argument; none reads a clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import once, round_half_up
from tessella.operators import scan

STATUSES = ["pending", "claimed", "retry_wait", "done", "failed", "needs_review"]
OPEN = ["pending", "claimed", "retry_wait", "needs_review"]
KEY = ["project_id", "lang", "chunk_index"]


def order_dimension(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """A fixed short list as rows with their place."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(done / total * 100)).otherwise(0).cast("int")


def status_counts(jobs: DataFrame, by: str = "project_id") -> DataFrame:
    return jobs.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "retry_wait", "claimed", "pending")), F.count(F.lit(1)).alias("total"))


def status_histogram(jobs: DataFrame) -> DataFrame:
    """Every known status, also those without rows, and any other that occurs."""
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return order_dimension(jobs.sparkSession, STATUSES, "status").join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def language_progress(jobs: DataFrame) -> DataFrame:
    agg = jobs.groupBy("project_id", "lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"))
    return agg.withColumn("percent", percent(F.col("done"), F.col("total")))


def current_language(progress: DataFrame) -> DataFrame:
    """Languages complete, and the first that is not, of each project."""
    complete = (F.col("total") > 0) & (F.col("done") >= F.col("total"))
    return progress.groupBy("project_id").agg(F.count_if(complete).alias("completed"), F.min(F.when(~complete, F.col("lang"))).alias("current"))


def last_done(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'done'").groupBy("project_id").agg(F.max(F.struct("completed_at", "lang", "chunk_index")).alias("m")).select("project_id", "m.completed_at", "m.lang", "m.chunk_index")


def first_incomplete(jobs: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "claimed", 0).when(F.col("status") == "retry_wait", 1).otherwise(2)
    return jobs.where("status <> 'done'").groupBy("project_id").agg(F.min(F.struct("lang", rank.alias("rank"), "chunk_index", "status")).alias("m")).select("project_id", "m.lang", "m.status", "m.chunk_index")


def completion_gate(jobs: DataFrame, declared: DataFrame) -> DataFrame:
    """(project_id, lang, done, total, complete): done or flagged chunks reach the declared and the present number."""
    agg = jobs.groupBy("project_id", "lang").agg(F.count_if(F.col("status").isin("done", "needs_review")).alias("done"), F.count(F.lit(1)).alias("present"))
    out = declared.join(agg, ["project_id", "lang"], "left").withColumn("total", F.greatest(F.col("declared"), F.coalesce("present", F.lit(0))))
    done = F.coalesce("done", F.lit(0))
    return out.select("project_id", "lang", done.alias("done"), "total", ((F.col("total") > 0) & (done >= F.col("total"))).alias("complete"))


def all_terminal(jobs: DataFrame, translations: DataFrame) -> DataFrame:
    """Projects none of whose jobs and translations is open."""
    done = translations.groupBy("project_id").agg(F.bool_and(F.col("status").isin("complete", "failed", "cancelled")).alias("ok")).where("ok").select("project_id")
    return done.join(jobs.where(F.col("status").isin(OPEN)).select("project_id").distinct(), "project_id", "left_anti")


def batch_summary(batches: DataFrame) -> DataFrame:
    ranges = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("first", "last")))), lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ", ")
    return batches.groupBy("project_id", "lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), ranges.alias("failed_ranges"))


def project_census(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each project with its counts, in one join where a loop would ask once a project."""
    return projects.join(status_counts(jobs), "project_id", "left").na.fill(0, ["done", "failed", "retry_wait", "claimed", "pending", "total"])


def open_projects(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    return projects.join(jobs.where(F.col("status").isin(OPEN)).select("project_id"), "project_id", "left_semi")


def unfinished(projects: DataFrame) -> DataFrame:
    """Projects whose status is null or not a final one."""
    return projects.where(F.col("status").isNull() | ~F.col("status").isin("cancelled", "complete", "all_translated"))


def stalled(translations: DataFrame, now: Column, after_ms: int = 600_000) -> DataFrame:
    last = F.coalesce("last_chunk_at", "started_at", F.lit(0))
    return translations.where(~F.coalesce(F.col("status").isin("complete", "generating"), F.lit(False)) & (now - last > after_ms))


def with_dimension(dimension: DataFrame, facts: DataFrame, on: str, defaults: dict, order: Sequence[Column] = ()) -> DataFrame:
    """Dimension rows in their order with the first fact of each by ``order`` (then by all fields), or defaults."""
    first = latest_per(facts, [on], [*order, *(F.col(c) for c in facts.columns)])
    return dimension.join(first, on, "left").na.fill(defaults).orderBy("ord")


def in_list_order(facts: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Facts by their place in a list, those outside it last."""
    return facts.join(dimension, on, "left").orderBy(F.coalesce("ord", F.lit(99)), on).drop("ord")


def latest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    place = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Table after changes: the highest version of each key wins; of equal ones the changes, then the greatest by all fields."""
    rows = table.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    return latest_per(rows, keys, [F.desc(version), F.desc("_change"), *(F.desc(c) for c in table.columns)]).drop("_change")


def patch(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table with changed fields; null fields of a change leave the old value."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return table.join(renamed, list(keys), "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "project_id") -> dict[str, DataFrame]:
    return {name: table.join(gone.select(key), key, "left_anti") for name, table in tables.items()}


def drift(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict) of files that are missing, extra or differ by digest."""
    m, a = manifest.select("path", F.col("sha256").alias("m")), actual.select("path", F.col("sha256").alias("a"))
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m") != F.col("a"), "mismatch")
    return m.join(a, "path", "full_outer").select("path", verdict.alias("verdict")).where("verdict is not null")


def import_edges(files: DataFrame) -> DataFrame:
    """(path, target) of imports that name a file: ``files`` has path and imports (array); reverse it for users of a file."""
    wanted = files.select("path", F.explode("imports").alias("spec"))
    names = files.select(F.col("path").alias("target"), F.regexp_extract("path", r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("name"))
    return wanted.join(names, F.regexp_extract("spec", r"([^/]+?)(?:\.[a-z]+)?$", 1) == F.col("name")).select("path", "target").distinct()


def flow_phase(status: Column, translations: Column, latest: Column) -> Column:
    """What a user sees of a project: idle, translating or all-complete; without one, by the latest project's status."""
    done = lambda s: s.isin("all_translated", "complete")
    own = F.when(done(status), "all-complete").when(status.isin("translating", "parsing") | ((status == "cancelled") & (F.coalesce(translations, F.lit(0)) > 0)), "translating").otherwise("idle")
    return F.when(status.isNotNull(), own).when(done(latest), "all-complete").when(latest == "translating", "translating").otherwise("idle")


def path_order(files: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``files`` (group, path) with ``group_place`` and ``place`` in the group, both from 1: groups in a fixed order, then others by name; paths as a reader of any language sorts them (Unicode collation)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, groups)), F.col("group")), F.lit(0)), F.lit(len(groups) + 1))
    names = files.select("group").distinct().withColumn("_rank", rank)
    placed = names.select(F.col("group").alias("_group"), F.row_number().over(W.orderBy("_rank", F.collate("group", "UNICODE"), "group")).alias("group_place"))
    own = W.partitionBy("group").orderBy(F.collate("path", "UNICODE"), "path")
    return files.withColumn("place", F.row_number().over(own)).join(placed, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")


def merged_text(chunks: DataFrame) -> DataFrame:
    """Done chunks of each (project, lang) as one text, in order."""
    done = chunks.where("status = 'done'").groupBy("project_id", "lang").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return done.select("project_id", "lang", F.array_join(F.col("c.text"), "\n\n").alias("text"), F.size("c").alias("chunks"))


def tail(text: Column, sentences: int = 2) -> Column:
    """The last sentences of a text."""
    return once(F.split(text, r"(?<=[.!?])[ \t\n]+"), lambda s: F.when(F.size(s) < sentences, text).otherwise(F.array_join(F.slice(s, -sentences, sentences), " ")))


def previous_tail(chunks: DataFrame, sentences: int = 2, width: int = scan.INDEXES) -> DataFrame:
    """Each chunk with the last sentences of the one before it, if that is done; a project and language may have any number of chunks."""
    tails = chunks.withColumn("_tail", F.when(F.col("status") == "done", tail(F.col("text"), sentences)))
    return scan.neighbour(tails, ["project_id", "lang"], scan.bucket_of(F.col("chunk_index"), width), ["chunk_index"], {"context": "_tail"}).drop("_tail")


def durations(jobs: DataFrame) -> DataFrame:
    """(n, avg_ms, p95_ms) of finished jobs, from claim to completion, by language."""
    took = (F.col("completed_at") - F.col("claimed_at")).cast("double")
    return jobs.where("completed_at is not null and claimed_at is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(took).alias("avg_ms"), F.percentile(took, 0.95).alias("p95_ms"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Sums of token counts whose keys come in two spellings."""
    total = lambda a, b: F.sum(F.coalesce(F.get_json_object("usage", f"$.{a}").cast("long"), F.get_json_object("usage", f"$.{b}").cast("long"), F.lit(0)))
    return usage.groupBy("lang").agg(total("prompt_tokens", "promptTokens").alias("prompt"), total("completion_tokens", "completionTokens").alias("completion"), total("total_tokens", "totalTokens").alias("total"))


def server_job_status(projects: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One row a project: counts, languages complete and current, and whether its server is alive."""
    from tessella.operators.jobs import alive

    counts, langs = status_counts(jobs), current_language(language_progress(jobs))
    out = projects.join(counts, "project_id", "left").join(langs, "project_id", "left")
    return out.withColumn("alive", alive(F.col("dispatcher_at"), F.col("watchdog_at"), F.col("activity_at"), now=now))


def stale_uploads(staging: DataFrame, uploads: DataFrame, now: Column, after_ms: int = 86_400_000) -> DataFrame:
    """Staging rows older than a day, and uploads whose heartbeat is."""
    return staging.where(now - F.col("created_at") > after_ms).unionByName(uploads.where(now - F.col("heartbeat_at") > after_ms))


def idle_dispatchers(projects: DataFrame, jobs: DataFrame, now: Column, ttl_ms: int = 360_000, quiet_ms: int = 600_000) -> DataFrame:
    """Projects with open jobs whose dispatcher or activity has been silent for too long."""
    silent = (now - F.coalesce("dispatcher_at", F.lit(0)) > ttl_ms) | (now - F.coalesce("activity_at", F.lit(0)) > quiet_ms)
    return open_projects(projects.where(silent), jobs)


def measured_rate(jobs: DataFrame, minutes: int = 10) -> DataFrame:
    return jobs.groupBy("project_id").agg(F.round(F.count_if(F.col("status") == "done") / minutes, 2).alias("rate"))


def key_check(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(n, keys): rows, and distinct keys; equal if the key is one."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*key).alias("keys"))


def open_languages(jobs: DataFrame) -> DataFrame:
    """Languages with jobs not done, but for those with failed ones."""
    pair = ["project_id", "lang"]
    return jobs.where("status <> 'done'").select(*pair).subtract(jobs.where("status = 'failed'").select(*pair))
