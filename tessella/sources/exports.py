"""Projects out to JSON and back, with all checks before any write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import scan

STATUSES = ["pending", "translating", "complete", "done", "failed"]
SHAPE = "type string, version int, langCodes array<string>, project struct<name:string,sourceText:string>, chunks array<struct<langCode:string,chunkIndex:int,sourceText:string,translatedText:string,status:string>>, translations array<struct<langCode:string,status:string,totalChunks:int,completedChunks:int,mergedText:string>>"


#: Chunks of one export row, and lines of one manifest row: a large project has several.
PART = 10_000
#: First letters of names that go together when a large project's files are numbered.
HEAD = 3


def in_parts(rows: DataFrame, order: list[str], bucket: Column, size: int) -> DataFrame:
    """Rows of each project with the number of their part, from 0, by ``order``; ``bucket`` grows with it and spreads a large project."""
    return scan.numbered(rows, ["project_id"], bucket, order, "_n").withColumn("part", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def export_json(projects: DataFrame, chunks: DataFrame, translations: DataFrame, size: int = PART) -> DataFrame:
    """(project_id, part, json): version 2, at most ``size`` chunks a part in order, and the translations in each."""
    c = in_parts(chunks, ["lang", "chunk_index"], F.struct("lang", scan.bucket_of(F.col("chunk_index"), scan.INDEXES)), size).groupBy("project_id", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("langCode"), F.col("chunk_index").alias("chunkIndex"), F.col("source_text").alias("sourceText"), F.col("text").alias("translatedText"), "status"))).alias("chunks"))
    t = translations.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("langCode"), "status", F.col("total").alias("totalChunks"), F.col("done").alias("completedChunks")))).alias("translations"))
    whole = F.struct(F.lit("project_export").alias("type"), F.lit(2).alias("version"), F.array_sort(F.array_distinct(F.col("translations.langCode"))).alias("langCodes"), F.struct(F.col("name")).alias("project"), "chunks", "translations")
    return projects.join(c, "project_id").join(t, "project_id").select("project_id", "part", F.to_json(whole).alias("json"))


def import_fault(json: Column, strict: bool = False) -> Column:
    """Why an export cannot be read, or null; ``strict`` takes version 1 alone."""
    parsed = F.from_json(json, SHAPE, {"mode": "PERMISSIVE"})
    return (
        F.when(parsed.isNull() | parsed["type"].isNull(), "not an export").when(parsed["type"] != "project_export", "wrong type").when(parsed["version"] != (1 if strict else 2), "wrong version")
        .when(parsed["project"].isNull(), "no project").when(parsed["chunks"].isNull(), "no chunks").when(F.exists(parsed["chunks"], lambda c: c["langCode"].isNull() | c["chunkIndex"].isNull()), "bad chunk")
    )


def imported_chunks(exports: DataFrame, json: str = "json", strict: bool = False) -> DataFrame:
    """Chunks of sound exports; unknown states are pending (with ``strict`` all but complete ones), faulty exports give none."""
    sound = exports.where(import_fault(F.col(json), strict).isNull())
    rows = sound.select("project_id", F.explode(F.from_json(json, SHAPE)["chunks"]).alias("c"))
    status = F.when(F.col("c.status") == "complete", "complete") if strict else F.when(F.col("c.status").isin(STATUSES), F.col("c.status"))
    return rows.select("project_id", F.col("c.langCode").alias("lang"), F.col("c.chunkIndex").alias("chunk_index"), F.col("c.sourceText").alias("source_text"), F.col("c.translatedText").alias("text"), F.coalesce(status, F.lit("pending")).alias("status"))


def zip_manifest(files: DataFrame, size: int = PART) -> DataFrame:
    """(project_id, part, manifest): one line a file, in order of its name, at most ``size`` a part."""
    return in_parts(files, ["name"], F.substring("name", 1, HEAD), size).groupBy("project_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "size"))), lambda f: F.format_string("%s  %d", f["name"], f["size"])), "\n").alias("manifest"))


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Download tokens that have not expired."""
    return tokens.where(F.col("expires_at") >= now)
