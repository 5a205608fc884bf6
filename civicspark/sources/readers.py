"""Files of documents: JSON, JSON Lines, text, pages of PDFs given as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One row for each JSON file, with its path; files below the folder are found at any depth."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def last_file_wins(df: DataFrame, key: str) -> DataFrame:
    """Of the rows with the same key the one of the last file by path."""
    rest = [c for c in df.columns if c not in (key, "file")]
    best = F.max_by(F.struct(*rest, "file"), "file").alias("b")
    return df.groupBy(key).agg(best).select(key, "b.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines give no row."""
    return spark.read.schema(schema).json(path).na.drop("all")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of text with their path."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def pages(text: Column) -> Column:
    """The pages of a text with form feeds between them."""
    return F.split(text, "\f")


def page_stats(pages_: Column) -> Column:
    """Characters, pages, empty pages and the share of sparse ones."""
    chars = F.transform(pages_, lambda p: F.length(F.trim(p)))
    return F.struct(
        F.aggregate(chars, F.lit(0), lambda a, x: a + x).alias("chars"), F.size(pages_).alias("pages"), F.size(F.filter(chars, lambda c: c == 0)).alias("empty_pages"),
        (F.size(F.filter(chars, lambda c: c < 50)) / F.greatest(F.size(pages_), F.lit(1))).alias("sparse_share"),
    )


def page_range(pages_: Column, start: int, end: int) -> Column:
    """Pages ``start`` to ``end``, counted from 1."""
    return F.slice(pages_, F.lit(start), F.lit(max(0, end - start + 1)))


def file_kind(content: Column) -> Column:
    """Kind of file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("504B0304"), "zip").otherwise("other")
    )


def named_like(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Text files whose name matches a glob such as ``seance-*.json``, at any depth: ``file`` and ``text``."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def without_trailing_number(page: Column) -> Column:
    """A page without the last line that holds only its number, and white space behind."""
    return F.regexp_replace(F.regexp_replace(page, r"\s+$", ""), r"(?i)\n\s*(?:page\s*)?\d{1,4}(?:\s*(?:/|sur|de)\s*\d{1,4})?$", "")


def positioned(pages_: DataFrame, id_col: str, pages_col: str) -> DataFrame:
    """The lines of text pages as blocks: ``id``, ``page`` from 1, ``block``, ``top`` and ``bottom`` as shares of the page's height, and ``text``.

    Without a library for PDF files the lines' order stands for their place.
    """
    paged = pages_.select(F.col(id_col).alias("id"), F.posexplode(pages_col).alias("page", "content")).select("id", (F.col("page") + 1).alias("page"), F.split("content", "\n").alias("ls"))
    each = paged.select("id", "page", F.size("ls").alias("n"), F.posexplode("ls").alias("block", "text"))
    return each.select("id", "page", "block", (F.col("block") / F.col("n")).alias("top"), ((F.col("block") + 1) / F.col("n")).alias("bottom"), F.trim("text").alias("text")).where("text <> ''")


def as_pages(kind: Column, text: Column) -> Column:
    """The pages of an attachment: those of its text for a PDF, one page for an image, none for anything else."""
    return F.when(kind == "pdf", pages(text)).when(kind.isin("png", "jpeg"), F.array(F.coalesce(text, F.lit("")))).otherwise(F.array().cast("array<string>"))
