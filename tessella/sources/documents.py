"""Where texts come from: tables, pages, scripts and files, with their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import symbols, trim_all, word_count

LARGE, TOO_LARGE, TOO_SMALL = 393_216, 50 * 1024 * 1024, 500


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_text(html: Column) -> Column:
    """Text between tags, scripts and styles left out."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return trim_all(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def html_title(html: Column) -> Column:
    return trim_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_items(pages: DataFrame, per_line: int = 12, lines_per_page: int = 40) -> DataFrame:
    """Positioned words of raw pages, laid out on a grid: doc_id, page, item_idx, str, x, y, width, height."""
    words = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.filter(F.split(html_text(F.col("html")), " "), lambda w: w != "")).alias("k", "str"))
    row = F.floor(F.col("k") / per_line)
    return words.select(
        "doc_id", (F.floor(row / lines_per_page) + 1).cast("int").alias("page"), F.col("k").alias("item_idx"), "str", (50.0 + (F.col("k") % per_line) * 40).alias("x"),
        (800.0 - (row % lines_per_page) * 16).cast("double").alias("y"), F.least(F.length("str") * 5.0, F.lit(36.0)).alias("width"), F.lit(10.0).alias("height"),
    )


def joined_items(items: DataFrame) -> DataFrame:
    """Text of each page: a line break where the baseline changes, a space else, none after a hyphen."""
    own = F.array_sort(F.collect_list(F.struct("item_idx", "str", "y")))
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, i: Column) -> Column:
        joiner = F.when(acc["t"] == "", "").when(acc["y"] != i["y"], "\n").when(F.endswith(acc["t"], F.lit("-")), "").otherwise(" ")
        return F.struct(F.concat(acc["t"], joiner, i["str"]).alias("t"), i["y"].alias("y"))

    return items.groupBy("doc_id", "page").agg(own.alias("i")).select("doc_id", "page", F.aggregate("i", start, step)["t"].alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Non-empty page texts of each document, by page, parted by a blank line."""
    own = F.array_sort(F.collect_list(F.when(trim_all(F.col("text")) != "", F.struct("page", "text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda p: p["text"]), "\n\n").alias("text"), F.size(own).alias("pages"))


def source_check(name: Column, n_bytes: Column, text: Column, pages: Column, pages_with_text: Column) -> Column:
    """First error of a source file, else its first warning, else null."""
    return (
        F.when(~F.lower(name).rlike(r"\.(pdf|txt)$"), "error: type").when(n_bytes > TOO_LARGE, "error: too large").when(n_bytes < TOO_SMALL, "error: too small")
        .when(F.length(trim_all(text)) < 10, "error: no text").when((pages > 5) & (pages_with_text < 0.3 * pages), "warning: sparse").when(word_count(text) < 50, "warning: few words")
        .when(pages_with_text < 0.5 * pages, "warning: images")
    )


def text_check(text: Column) -> Column:
    n = word_count(text)
    return F.when(n < 10, "error: too short").when(n > 5000, "warning: long")


def offloaded(rows: DataFrame, value: str) -> DataFrame:
    """``inline`` or ``blob`` for each row, by the size of its value as JSON."""
    size = F.octet_length(F.to_json(F.struct(F.col(value).alias("v")))) - F.lit(len('{"v":}'))
    return rows.withColumn("json_bytes", size).withColumn("place", F.when(size > LARGE, "blob").otherwise("inline"))


def resolved(rows: DataFrame, blobs: DataFrame, key: str, value: str) -> DataFrame:
    """Inline values, or those of the side table."""
    return rows.join(blobs.select(key, F.col(value).alias("_blob")), key, "left").withColumn(value, F.coalesce("_blob", value)).drop("_blob")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256, category of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    category = F.when(kind.isin("py", "ts", "tsx", "js", "mjs", "cjs"), "code").when(kind.isin("json", "csv", "parquet"), "data").when(kind.isin("md", "html", "txt"), "docs").otherwise("other")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), category.alias("category"))


def script_symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, exports and imports of scripts."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), symbols(F.col("value")).alias("s")).select("path", "s.exports", "s.imports")


def extracted_names(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, name) of captions that texts carry, ready for ``write.csv``."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)\b(map|figure|table)[ \t]+([0-9]+)"), F.lit(0))
    return docs.select(id_col, F.explode(found).alias("name")).select(id_col, F.lower(F.regexp_extract("name", "^([A-Za-z]+)", 1)).alias("kind"), "name")
