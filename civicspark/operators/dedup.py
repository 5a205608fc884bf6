"""Deduplication by rank, first or last occurrence, with what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with the same keys the first by ``order``; rows with a null key form a group as well."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def keep_with_occurrences(df: DataFrame, key: Column, id_col: str, order: Column) -> DataFrame:
    """One row for each key: the first id by ``order``, how many ids have it, and the last id.

    Occurrences are counted, not gathered, as one key may hold any share of the rows.
    """
    return df.select(key.alias("key"), F.col(id_col).alias("id"), order.alias("o")).where("key is not null").groupBy("key").agg(
        F.min_by("id", F.struct("o", "id")).alias("kept"), F.count_distinct("id").alias("occurrences"), F.max_by("id", F.struct("o", "id")).alias("last")
    )


def dropped_by_content(df: DataFrame, content_key: Column, id_col: str, rank: Column) -> DataFrame:
    """For rows with the same content: which id is kept (lowest rank, then id) and which are dropped for it."""
    keyed = df.select(content_key.alias("key"), F.col(id_col).alias("id"), rank.alias("rank")).where("key is not null").distinct()
    best = keyed.groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("kept"), F.count_distinct("id").alias("n")).where("n > 1")
    return keyed.join(best, "key").where("id <> kept").select(F.col("id").alias("dropped"), "kept").distinct()


def aliases(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Ids that share a key: each with the smallest of them and the number of the others."""
    keyed = df.select(key.alias("key"), F.col(id_col).alias("id")).where("key is not null and key <> ''").distinct()
    groups = keyed.groupBy("key").agg(F.min("id").alias("main"), (F.count("*") - 1).alias("others")).where("others > 0")
    return keyed.join(groups, "key").select("id", "main", "others").distinct()


def interleave(df: DataFrame, group: str, order: list[Column], id_col: str, limit: int | None = None) -> DataFrame:
    """Round robin over the groups: first the best row of each, then the second; an id comes once.

    ``place`` is the position in the result.  With a limit only that many rows
    of each group are ranked further.
    """
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col("rn") <= limit)
    once = keep_first(ranked, [id_col], [F.col("rn"), F.col(group)])
    if limit is None:
        return once.withColumn("place", F.struct("rn", group))
    top = once.orderBy("rn", group).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rn", group)))


def best_and_margin(df: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """The best candidate of each key, its score and how far the next one is behind (its own score if it is alone)."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc(candidate))
    ranked = df.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead(score).over(order))
    return ranked.where("rn = 1").select(key, candidate, score, (F.col(score) - F.coalesce("next", F.lit(0.0))).alias("margin"))


def tier(score: Column, margin: Column) -> Column:
    """exact, probable or manual, by score and margin."""
    return F.when((score >= 0.98) & (margin >= 0.05), "exact").when((score >= 0.76) & (margin >= 0.08), "probable").otherwise("manual")
