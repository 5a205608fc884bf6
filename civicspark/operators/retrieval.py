"""Ranked retrieval: exact vector search, title and keyword search, their fusion and expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import ilike_contains
from civicspark.operators.dedup import interleave, keep_first


def cosine(vector: Column, query: Sequence[float] | Column) -> Column:
    """Cosine similarity in double precision; null for a null vector, one of another length or without direction.

    A query given as numbers is brought to length 1 once, not for every row.
    """
    v = vector.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(total(F.transform(v, lambda a: a * a)))
    if isinstance(query, Column):
        q = query.cast("array<double>")
        return F.when(F.size(v) == F.size(q), total(F.zip_with(v, q, lambda a, b: a * b)) / F.nullif(norm * F.sqrt(total(F.transform(q, lambda a: a * a))), F.lit(0.0)))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    if not length:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(float(x) / length) for x in query])
    return F.when(F.size(v) == len(query), total(F.zip_with(v, q, lambda a, b: a * b)) / F.nullif(norm, F.lit(0.0)))


def vector_search(chunks: DataFrame, query: Sequence[float], limit: int, where: Column | None = None, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The chunks most similar to a vector: exact, ties by id.

    Filters come before the distance; the top rows are taken without a full sort.
    """
    rows = chunks.where(where) if where is not None else chunks
    return rows.withColumn("score", cosine(F.col(vector), query)).where("score is not null").orderBy(F.desc("score"), id_col).limit(limit)


def vector_search_once(chunks: DataFrame, query: Sequence[float], limit: int, id_cols: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Like ``vector_search``, for tables in which a chunk may stand twice: only its ids and its best score are kept."""
    scored = chunks.select(*id_cols, cosine(F.col(vector), query).alias("score")).where("score is not null")
    return scored.groupBy(*id_cols).agg(F.max("score").alias("score")).orderBy(F.desc("score"), id_cols[0]).limit(limit)


def vector_search_per_group(chunks: DataFrame, query: Sequence[float], k: int, group: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """The k most similar rows of each group in one pass."""
    scored = chunks.withColumn("score", cosine(F.col(vector), query)).where("score is not null")
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), id_col))).where(F.col("rn") <= k)


def title_search(chunks: DataFrame, documents: DataFrame, phrase: str, limit: int = 15) -> DataFrame:
    """Chunks of the documents whose title holds the phrase, score 1, in document order."""
    hits = documents.where(ilike_contains(F.col("title"), phrase)).select("document_id", "title", "category")
    return chunks.join(hits, "document_id").withColumn("score", F.lit(1.0)).orderBy("document_id", "chunk_index", "chunk_id").limit(limit)


def keyword_search(chunks: DataFrame, documents: DataFrame, keyword: str, limit: int = 40, per_document: int = 2, where: Column | None = None) -> DataFrame:
    """Chunks whose title or content holds the keyword, score 0.9, at most ``per_document`` of each document.

    Contents aren't carried on: hits are brought together by their ids, those delivered twice once.
    """
    docs = documents.where(where) if where is not None else documents
    joined = chunks.join(docs.select("document_id", "title", "category"), "document_id")
    hit = F.coalesce(ilike_contains(F.col("title"), keyword), F.lit(False)) | F.coalesce(ilike_contains(F.col("content"), keyword), F.lit(False))
    ids = joined.where(hit).select("chunk_id", "document_id", "chunk_index", "title", "category").dropDuplicates(["chunk_id"])
    ranked = ids.withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")))
    return ranked.where(F.col("rn") <= per_document).withColumn("score", F.lit(0.9)).orderBy("document_id", "chunk_index", "chunk_id").limit(limit)


def fuse(titles: DataFrame, keywords: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Title hits, then keyword hits (half the limit, one chunk of each document not seen before), then vector hits.

    Columns ``chunk_id``, ``document_id`` and ``score``; ``place`` counts from 1.
    """
    cols = ["chunk_id", "document_id", "score"]
    t = titles.select(*cols).withColumn("stage", F.lit(0))
    k = keywords.select(*cols).join(titles.select("document_id").distinct(), "document_id", "left_anti")
    k = keep_first(k, ["document_id"], [F.desc("score"), F.col("chunk_id")]).orderBy(F.desc("score"), "document_id", "chunk_id").limit(limit // 2).select(*cols).withColumn("stage", F.lit(1))
    v = vectors.select(*cols).withColumn("stage", F.lit(2))
    once = keep_first(t.unionByName(k).unionByName(v), ["chunk_id"], [F.col("stage"), F.desc("score")])
    top = once.orderBy("stage", F.desc("score"), "document_id", "chunk_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("stage", F.desc("score"), "document_id", "chunk_id")))


def expand_small_documents(results: DataFrame, chunks: DataFrame, top: int = 3, most: int = 15) -> DataFrame:
    """All chunks of the best ``top`` documents that have at most ``most`` chunks, with their document's score, and the other results.

    A larger document takes its place among the best without being expanded.
    """
    best = results.groupBy("document_id").agg(F.max("score").alias("doc_score")).orderBy(F.desc("doc_score"), "document_id").limit(top)
    members = chunks.join(F.broadcast(best), "document_id")
    small = members.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("document_id")
    added = members.join(small, "document_id").select("chunk_id", "document_id", F.col("doc_score").alias("score"))
    return results.select("chunk_id", "document_id", "score").unionByName(added).groupBy("chunk_id", "document_id").agg(F.max("score").alias("score"))


def group_by_document(results: DataFrame) -> DataFrame:
    """Best score and number of passages of each document."""
    return results.groupBy("document_id").agg(F.max("score").alias("top_score"), F.count("*").alias("passages"))


def balanced(results: DataFrame, group: str, limit: int) -> DataFrame:
    """Results interleaved over their groups, ``limit // groups`` of each at least one."""
    n = results.select(group).distinct().count()
    each = max(1, limit // max(1, n))
    ranked = results.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "chunk_id"))).where(F.col("__r") <= each).drop("__r")
    return interleave(ranked, group, [F.desc("score"), F.col("chunk_id")], "chunk_id", limit)


def weak(results: DataFrame, documents: int = 2, score: float = 0.75) -> bool:
    """Whether a search should be tried again with a broader question."""
    row = results.agg(F.count_distinct("document_id"), F.max("score")).first()
    return row[0] < documents or (row[1] or 0.0) < score


def retried(first: DataFrame, broadened: DataFrame) -> DataFrame:
    """The first results, or those of the broadened question where the first are weak and the others' best score is higher."""
    if not weak(first):
        return first
    best = lambda df: df.agg(F.max("score")).first()[0] or 0.0
    return broadened if best(broadened) > best(first) else first


def evidence(results: DataFrame, limit: int = 15) -> DataFrame:
    """What an answer is made from: results interleaved over the communes, in order of their names, those without one last; ``place`` counts from 1."""
    known = results.withColumn("__g", F.coalesce(F.nullif(F.trim("commune"), F.lit("")), F.lit("\uffff")))
    return interleave(known, "__g", [F.desc("score"), F.col("chunk_id")], "chunk_id", limit).drop("__g")


def stable_order(results: DataFrame, columns: Sequence[Column]) -> list[Column]:
    """Sort keys in which a null counts as empty text, with the insertion order as the last one."""
    return [*[F.coalesce(c, F.lit("")) for c in columns], F.col("place")]


def rerank_filled(results: DataFrame, chosen: Sequence[str], keep: int) -> DataFrame:
    """Chosen ids in the given order, then the others in theirs, ``keep`` in all; ``place`` is the order of ``results``."""
    order = F.array_position(F.array(*[F.lit(c) for c in chosen]) if chosen else F.array().cast("array<string>"), F.col("chunk_id"))
    return results.withColumn("__c", F.when(order > 0, order)).orderBy(F.asc_nulls_last("__c"), "place").limit(keep).drop("__c")


def responses(documents: DataFrame) -> DataFrame:
    """Objects and the responses that belong to them by their common number: ``object_id`` and ``response_id``."""
    key = F.regexp_extract("document_id", r"^(.*_\d+)_", 1)
    rows = documents.select("document_id", "document_role", key.alias("key")).where("key <> ''").distinct()
    objects = rows.where(F.col("document_role").isin("interpellation_text", "postulat_text", "postulate_text", "motion_text")).select("key", F.col("document_id").alias("object_id"))
    answers = rows.where(F.col("document_role") == "municipal_response").select("key", F.col("document_id").alias("response_id"))
    return objects.join(answers, "key", "left").select("object_id", "response_id")
