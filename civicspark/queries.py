"""Queries of the core; each takes (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark import catalog_objects, catalog_records, catalog_sections, catalog_sources  # noqa: F401  register their queries
from civicspark.catalog import CATALOG
from civicspark.functions import dates
from civicspark.operators import retrieval, segment
from civicspark.sources.tables import table


def entry(spark: SparkSession, directory: str) -> DataFrame:
    """Documents cut into windows, distinct contents, ranked by how close they are to a vector of their source's label."""
    pieces = segment.chunked(table(spark, directory, "documents"), "doc_id", "text")
    distinct = pieces.withColumn("content_hash", dates.content_hash(F.col("content"))).groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"), F.min("word_count").alias("word_count"))
    query = table(spark, directory, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    near = retrieval.vector_search(table(spark, directory, "embeddings"), query, 20, id_col="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))
    keyed = distinct.withColumn("vec_id", F.split("chunk_id", "#")[0].cast("long"))
    return near.join(keyed, "vec_id", "left").select("vec_id", "label", "score", "chunk_id", "word_count").orderBy(F.desc("score"), "vec_id", "chunk_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (_, run, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in CATALOG.items() if sql}
