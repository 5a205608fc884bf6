"""Filters, structured listings and counts over documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.text import CATEGORIES, matches_keywords

#: Roles that aren't primary documents (fixed values).
SECONDARY_ROLES = ("municipal_response", "response", "status_report", "council_decision", "consideration_report", "commission_report")


def browser_year(date: Column, listing_year: Column) -> Column:
    return F.coalesce(F.nullif(listing_year.cast("string"), F.lit("")), F.nullif(F.left(date, F.lit(4)), F.lit("")))


def year_between(year: Column, low: str | None, high: str | None) -> Column:
    """Four-digit years compared as text; open at either end."""
    out = F.lit(True)
    if low:
        out = out & (year >= low)
    if high:
        out = out & (year <= high)
    return out


def primary(role: Column) -> Column:
    """Whether a role is that of a primary document; null is."""
    return ~F.coalesce(role, F.lit("")).isin(*SECONDARY_ROLES)


def canonical(flag: Column) -> Column:
    """Whether a record is an object of its own; only the text ``false`` says no."""
    return F.coalesce(flag.cast("string"), F.lit("true")) != "false"


def browse(
    documents: DataFrame, communes: Sequence[str] = (), categories: Sequence[str] = (), keywords: Sequence[str] = (), year_from: str | None = None, year_to: str | None = None,
    limit: int = 200, metadata: Column | None = None,
) -> DataFrame:
    """Primary documents, newest first, at most ``limit`` (1 to 2000).

    Keywords are looked for in both titles and, if given, in the text of the
    metadata; records that say that they are no objects of their own
    (``canonical_object``) are left out.
    """
    year = browser_year(F.col("document_date"), F.col("listing_year"))
    rows = documents.where(primary(F.col("document_role"))).withColumn("year", year)
    if "canonical_object" in documents.columns:
        rows = rows.where(canonical(F.col("canonical_object")))
    if communes:
        rows = rows.where(F.col("commune").isin(*communes))
    if categories:
        rows = rows.where(F.col("category").isin(*[CATEGORIES.get(c, c) for c in categories]))
    if keywords:
        rows = rows.where(matches_keywords(keywords, F.col("title"), F.col("source_title"), *([metadata] if metadata is not None else [])))
    rows = rows.where(year_between(F.col("year"), year_from, year_to)) if year_from or year_to else rows
    return rows.orderBy(F.desc_nulls_last("year"), F.asc_nulls_last("commune"), F.asc_nulls_last("title"), "document_id").limit(max(1, min(limit, 2000))).select("document_id", "year", "commune", "category", "title")


def filters(spec: dict) -> Column:
    """The conjunction of the filters that are set: city, doc_type, article, year.

    ``all`` and unknown types filter nothing, as a question may name none.
    """
    out = F.lit(True)
    city = str(spec.get("city") or "").strip()
    if city and city.lower() != "all":
        out = out & (F.col("commune") == city)
    if (kind := str(spec.get("doc_type") or "").lower()) in CATEGORIES:
        out = out & (F.col("category") == CATEGORIES[kind])
    if spec.get("article"):
        out = out & (F.col("article") == str(spec["article"]))
    if spec.get("year"):
        out = out & (F.col("listing_year").cast("string") == str(spec["year"]))
    return out


def relaxed(spec: dict) -> list[dict]:
    """Weaker versions of the filters, in order: without the year, then the city alone; none twice."""
    fewer = [{k: spec[k] for k in spec if k != "year"}] if spec.get("year") else []
    alone = [{k: spec[k] for k in ("city",) if spec.get(k)}] if spec else []
    return fewer + [a for a in alone if a not in fewer[-1:]]


def author_listing(documents: DataFrame) -> DataFrame:
    """Authors of each document: ``document_id``, ``name`` and ``role``, once each."""
    return documents.select("document_id", F.explode("authors").alias("a")).select("document_id", "a.name", "a.party", "a.civility", "a.role").where("name is not null").distinct()


def authors_by_document(documents: DataFrame) -> DataFrame:
    """The sorted set of authors of each document, joined by commas, and their number."""
    authors = author_listing(documents).select("document_id", "name").distinct()
    return authors.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("authors"), F.count("*").alias("n"))


def counts_by(documents: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Documents for each combination of keys, and how many satisfy each condition."""
    return documents.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """The rows of a page, counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def available_types(municipalities: DataFrame, communes: Sequence[str]) -> DataFrame:
    """Document types that at least one of the communes offers; of all searchable ones if none is named."""
    rows = municipalities.where("search_enabled")
    if communes:
        rows = rows.where(F.col("label").isin(*communes))
    return rows.select(F.explode("document_types").alias("document_type")).distinct()


def result_rows(found: DataFrame, source: str) -> DataFrame:
    """The rows of a search as they are handed on: ids, texts, the first URL known, the score rounded to six decimals, and the search they come from.

    ``found`` has ``chunk_id``, ``document_id``, ``title``, ``category``,
    ``content``, ``file_url``, ``source_page_url``, ``summary`` and ``score``;
    the metadata is a map without empty entries.
    """
    url = F.coalesce(F.nullif("file_url", F.lit("")), F.nullif("source_page_url", F.lit("")), F.lit(""))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(F.col(k), F.lit("")).alias("v")) for k in ("title", "category", "document_id", "summary")])
    return found.select(
        F.col("chunk_id").alias("id"), "document_id", "title", F.col("category").alias("doc_type"), F.col("content").alias("text"), url.alias("source_url"), F.round("score", 6).alias("score"), F.lit(source).alias("search_source"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("metadata"),
    )


def author_years(documents: DataFrame) -> DataFrame:
    """Each author, folded, with each year: ``author`` and ``year``, an unknown year as empty text."""
    from civicspark.functions.text import fold

    rows = documents.select(F.explode("authors").alias("a"), F.coalesce(F.col("listing_year").cast("string"), F.lit("")).alias("year"))
    return rows.select(F.trim(fold(F.col("a.name"))).alias("author"), "year").where("author <> ''").distinct()
