"""Audits of documents and chunks: issues, severities, reports.

Names of issues and reasons, and the limits they stand for, are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import compact, word_count


def issues(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, sorted; a rule that is null doesn't."""
    return F.filter(F.array(*[F.when(rule, name) for name, rule in sorted(rules.items())]), lambda x: x.isNotNull())


def chunk_issues(words: Column, component: Column, section_title: Column, is_last: Column, most: int = 450, least: int = 60) -> Column:
    return issues(
        {
            "chunk_too_long": words > most, "chunk_too_short": (words < least) & ~is_last, "component_not_detected": component == "unknown_component",
            "section_title_missing": F.coalesce(section_title, F.lit("")) == "",
        }
    )


def traffic_light(found: Column) -> Column:
    """red for a chunk that is too long, yellow for any other issue, green for none."""
    return F.when(F.array_contains(found, "chunk_too_long"), "red").when(F.size(found) > 0, "yellow").otherwise("green")


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Issues and traffic light of each chunk; the last chunk of a document may be short."""
    last = F.col("chunk_index") == F.max("chunk_index").over(Window.partitionBy("document_id"))
    counted = chunks.withColumn("words", word_count(F.col("content"))).withColumn("last", last)
    found = chunk_issues(F.col("words"), F.col("component"), F.col("section_title"), F.col("last"))
    return counted.withColumn("issues", found).select("chunk_id", "words", F.array_join("issues", ",").alias("issues"), traffic_light(F.col("issues")).alias("quality"))


def missing_fields(required: list[str]) -> Column:
    """The required fields that are null or empty, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in required]), lambda x: x.isNotNull())


def input_issues(chunks: DataFrame, required: list[str]) -> DataFrame:
    """What speaks against embedding a chunk: missing fields, page numbers, too few or too many words or characters, issues found before."""
    content = F.trim(F.coalesce("content", F.lit("")))
    words = word_count(content)
    own = issues(
        {
            "content_over_500_words": words > 500, "content_under_10_words": words.between(1, 9), "inline_page_marker": content.rlike(r"\b\d{1,3}\s*\|\s*\d{1,3}\b"),
            "input_over_24000_characters": F.length(content) > 24_000, "standalone_page_number": content.rlike(r"(?i)\A(?:page\s*)?\d{1,3}\z"),
        }
    )
    upstream = F.transform(F.coalesce("quality_issues", F.array().cast("array<string>")), lambda x: F.concat(F.lit("upstream:"), x))
    missing = F.transform(missing_fields(required), lambda x: F.concat(F.lit("missing:"), x))
    return chunks.select("chunk_id", F.sort_array(F.array_distinct(F.concat(missing, own, upstream))).alias("issues"))


def histogram(df: DataFrame, array: str, name: str = "issue") -> DataFrame:
    """How often each element occurs."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys that several members share: ``key``, how many, the surplus, and the first member.

    Members themselves are not gathered, as a group may hold any share of the rows.
    """
    return df.select(key.alias("key"), F.col(member).alias("member")).where("key is not null").distinct().groupBy("key").agg(F.count("*").alias("members"), (F.count("*") - 1).alias("surplus"), F.min("member").alias("first_member")).where("members > 1")


def tagged_duplicates(df: DataFrame, key: Column, name: str = "is_duplicate") -> DataFrame:
    """All rows, with a flag for those whose key occurs more than once; null keys never do.

    Counts are aggregated before they are joined back, so a hot key is no hot task.
    """
    keyed = df.withColumn("__key", key)
    counts = keyed.where("__key is not null").groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1")
    return keyed.join(counts, "__key", "left").withColumn(name, F.col("__n").isNotNull()).drop("__key", "__n")


def documents_without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have no chunk, with the reason that their extraction suggests."""
    reason = (
        F.when(F.col("extraction_method").isin("ocr_required", "native_pdf_pending_ocr"), "ocr_pending").when(F.col("extraction_method").isNull(), "extraction_unknown").otherwise("no_text")
    )
    return documents.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select("document_id", reason.alias("reason")).distinct()


def preindex_audit(documents: DataFrame, chars: DataFrame, required: list[str]) -> DataFrame:
    """Status of each document before indexing: blocked, ready_with_warnings or ready.

    ``chars`` has ``document_id`` and ``chars``.  A missing required field and
    text that awaits OCR block; less than 500 characters warn.
    """
    joined = documents.join(chars, "document_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    blockers = F.concat(
        F.transform(missing_fields(required), lambda x: F.concat(F.lit("missing_"), x)),
        issues({"ocr_required": F.col("extraction_method").isin("ocr_required", "native_pdf_pending_ocr")}),
    )
    pending = F.col("extraction_method").isin("ocr_required", "native_pdf_pending_ocr")
    warnings = issues({"very_short_text": (F.col("chars") < 500) & ~F.coalesce(pending, F.lit(False))})
    return (
        joined.withColumn("b", blockers).withColumn("w", warnings)
        .select(
            "document_id", F.array_join("b", ",").alias("blockers"), F.array_join("w", ",").alias("warnings"),
            F.when(F.size("b") > 0, "blocked").when(F.size("w") > 0, "ready_with_warnings").otherwise("ready").alias("status"),
        )
    )


def field_status(old: Column, new: Column) -> Column:
    """How a field differs between two records: identical, different, only_old, only_new or both_missing."""
    o, n = F.nullif(compact(old), F.lit("")), F.nullif(compact(new), F.lit(""))
    return F.when(o.isNull() & n.isNull(), "both_missing").when(n.isNull(), "only_old").when(o.isNull(), "only_new").when(o == n, "identical").otherwise("different")


def compare_records(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field comparison of two versions of a table: ``key``, ``field`` and ``status``."""
    a = old.select(F.col(key), *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    b = new.select(F.col(key), *[F.col(f).cast("string").alias(f"new_{f}") for f in fields])
    pairs = [F.struct(F.lit(f).alias("field"), field_status(F.col(f"old_{f}"), F.col(f"new_{f}")).alias("status")) for f in fields]
    return a.join(b, key, "full_outer").select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.*")


def expectations(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected values (``name``, ``value``) that the actual ones differ from or lack."""
    return (
        expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "name", "left")
        .where(~F.col("expected").eqNullSafe(F.col("actual"))).select("name", "expected", "actual")
    )


def repeated_margin_lines(pages: DataFrame, page: str, group: str, text: str, edge: int = 5, share: float = 0.35, least: int = 3) -> DataFrame:
    """Lines among the first or last ``edge`` of a page that recur on many pages of their group.

    A line recurs if it is on at least ``max(least, round(share * pages))``
    pages; rounding is half to even.  Only the lines at the edges are moved;
    pages delivered twice count once.
    """
    lines = F.split(text, "\n")
    edges = F.array_distinct(F.transform(F.concat(F.slice(lines, F.lit(1), F.lit(edge)), F.slice(lines, F.greatest(F.size(lines) - edge + 1, F.lit(1)), F.lit(edge))), compact))
    margin = pages.select(group, page, F.explode(F.filter(edges, lambda x: x != "")).alias("line")).distinct()
    sizes = pages.select(group, page).distinct().groupBy(group).agg(F.count("*").alias("pages"))
    hits = margin.groupBy(group, "line").agg(F.count("*").alias("hits"))
    return hits.join(sizes, group).where(F.col("hits") >= F.greatest(F.lit(least), F.bround(F.col("pages") * share, 0))).select(group, "line", "hits", "pages")


def one_row(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it has exactly one row, else an error that names what was expected."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"exactly one {what} expected, found {'none' if n == 0 else 'several'}")
    return df


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side; empty if the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


#: Lines that say nothing of a document (fixed values); ``{host}`` is the website's name.
BOILERPLATE = (
    r"^(?:-|–)?\s*\d{1,4}\s*(?:-|–)?$", r"(?i)^(?:Conseil communal|Municipalité|Maison de commune|Au Conseil communal de)$", r"(?i)\bwww\.{host}\b", r"(?i)\b[\w.+-]+@(?:[\w-]+\.)*{host}\b",
    r"(?i)\.(?:docx?|odt)\s*$", r"^\+?[\d ]{10,16}$",
)


def boilerplate(line: Column, host: str) -> Column:
    """Whether a line is an address, a contact, a file name or a page number."""
    out = F.lit(False)
    for p in BOILERPLATE:
        out = out | line.rlike(p.replace("{host}", rf"\Q{host}\E"))
    return out


def margin_keys(lines: DataFrame, edge: int = 5, share: float | None = 0.35, least: int = 3, length: tuple[int, int] = (3, 120), allowed: Column | None = None) -> DataFrame:
    """Lines, in lower case, that stand among the first or last ``edge`` of many pages of a document: ``document``, ``key`` and ``pages``.

    ``lines`` has ``document``, ``page``, ``position``, ``lines`` (how many the
    page has) and ``line``.  Many are ``max(least, round(share * pages))``,
    half to even, or ``least`` without a share; ``allowed`` restricts the lines.
    """
    text = compact(F.col("line"))
    margin = lines.where((F.col("position") < edge) | (F.col("position") >= F.col("lines") - edge))
    if allowed is not None:
        margin = margin.where(allowed)
    keyed = margin.select("document", "page", F.lower(text).alias("key")).where(F.length("key").between(*length)).distinct()
    hits = keyed.groupBy("document", "key").agg(F.count("*").alias("pages"))
    if share is None:
        return hits.where(F.col("pages") >= least)
    sizes = lines.select("document", "page").distinct().groupBy("document").agg(F.count("*").alias("n"))
    return hits.join(sizes, "document").where(F.col("pages") >= F.greatest(F.lit(least), F.bround(F.col("n") * share, 0))).select("document", "key", "pages")


def cleaned_pages(lines: DataFrame, margins: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """The pages' lines that stay, and those taken out with the reason: repeated_margin before boilerplate.

    Headings and rows of tables in Markdown stay, even where they are repeated.
    """
    text = compact(F.col("line"))
    keyed = lines.withColumn("key", F.lower(text)).join(margins.select("document", "key", F.lit(True).alias("margin")), ["document", "key"], "left")
    protected = F.startswith(text, F.lit("#")) | F.startswith(text, F.lit("|"))
    image = text.rlike(r"^!\[[^\]]*\]\([^)]*\)$")
    reason = F.when(text == "", None).when(image, "ocr_image_marker").when(protected, None).when(F.col("margin"), "repeated_margin").when(boilerplate(text, host), "boilerplate")
    judged = keyed.select("document", "page", "position", text.alias("line"), reason.alias("reason"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def block_reasons(blocks: DataFrame, titles: DataFrame, band: float = 0.14) -> DataFrame:
    """The positioned blocks of documents with the reason that speaks against them, null for the others.

    ``blocks`` has ``document``, ``page``, ``block``, ``top``, ``bottom`` (shares
    of the page's height) and ``text``.  A text that stands in the upper or
    lower band of half of the pages, two at least, is a header or footer;
    contacts near the edge, file names, page numbers, and the head of a response
    or the document's own title on the first page's upper part don't count either.
    """
    from civicspark.functions.text import normalized_words

    keyed = blocks.withColumn("key", normalized_words(F.col("text")))
    pages = blocks.select("document", "page").distinct().groupBy("document").agg(F.count("*").alias("n"))
    inside = keyed.where(((F.col("bottom") <= band) | (F.col("top") >= 1 - band)) & (F.col("key") != "")).groupBy("document", "key").agg(F.count("*").alias("hits"))
    repeated = inside.join(pages, "document").where(F.col("hits") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.5))).select("document", "key", F.lit(True).alias("repeated"))
    named = keyed.join(repeated, ["document", "key"], "left").join(titles.select("document", normalized_words(F.col("title")).alias("title_key")), "document", "left")
    t, near, high = F.col("text"), (F.col("bottom") <= 0.2) | (F.col("top") >= 0.8), (F.col("page") == 1) & (F.col("bottom") <= 0.38)
    own_title = (F.col("title_key") != "") & (F.length("key") > 25) & (F.contains("key", F.col("title_key")) | F.contains("title_key", F.col("key")))
    reason = (
        F.when(F.col("repeated"), "repeated_header_or_footer").when(near & t.rlike(r"(?i)\b\d{2,3}\s+\d{3}\s+\d{2}\s+\d{2}\b|@|www\."), "contact_boilerplate").when(t.rlike(r"(?i)\.docx\b"), "internal_filename")
        .when(t.rlike(r"(?i)^\s*(?:page\s*)?\d+\s*(?:/|sur|\|)\s*\d+\s*$"), "page_number").when(high & t.rlike(r"(?iu)R[ÉE]PONSE\s+MUNICIPALE\s+N[°ºO]"), "response_header").when(high & own_title, "document_title")
    )
    return named.select("document", "page", "block", "text", reason.alias("reason"))


def preindex_findings(documents: DataFrame, required: list[str]) -> DataFrame:
    """What is found in each document before it is indexed: ``document_id``, ``severity`` (blocker, warning, info) and ``code``.

    ``documents`` has the required fields, ``text_error``, ``needs_ocr``,
    ``text_chars``, ``empty_pages``, ``author``, ``title``, ``occurrences`` and ``pdf_url``.
    """
    failed, ocr = F.coalesce(F.col("text_error"), F.lit("")) != "", F.coalesce("needs_ocr", F.lit(False))
    rules = [(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", "blocker", f"missing_{f}") for f in required]
    rules += [
        (failed, "blocker", "pdf_text_extraction_failed"), (~failed & ocr, "blocker", "ocr_required"), (~failed & ~ocr & (F.coalesce("text_chars", F.lit(0)) < 500), "warning", "very_short_text"),
        (F.coalesce("empty_pages", F.lit(0)) > 0, "warning", "empty_pages"), (F.coalesce("author", F.lit("")) == "", "warning", "missing_author"), (F.coalesce(F.col("title"), F.lit("")).rlike(r"(?i)\.pdf$"), "warning", "filename_as_title"),
        (F.coalesce("occurrences", F.lit(0)) > 1, "info", "duplicate_listing_occurrences"), (~F.coalesce(F.col("pdf_url"), F.lit("")).rlike("^(?i)https://"), "warning", "non_https_source"),
    ]
    found = F.filter(F.array(*[F.when(rule, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for rule, severity, code in rules]), lambda x: x.isNotNull())
    return documents.select("document_id", F.inline(found))


def preindex_status(findings: DataFrame, failed_downloads: DataFrame) -> DataFrame:
    """One row: totals by severity and the status of the whole load, blocked, ready_with_warnings or ready.

    Downloads that failed count as one finding: a warning if all were recovered (``equivalent_id``), else a blocker.
    """
    sources = failed_downloads.agg(F.count("*").alias("failed"), F.count("equivalent_id").alias("recovered"))
    totals = findings.agg(*[F.count_if(F.col("severity") == x).alias(f"{x}s") for x in ("blocker", "warning", "info")])
    both = totals.join(F.broadcast(sources))
    blockers = F.col("blockers") + (F.col("failed") > F.col("recovered")).cast("long")
    warnings = F.col("warnings") + ((F.col("failed") > 0) & (F.col("failed") == F.col("recovered"))).cast("long")
    return both.select(blockers.alias("blockers"), warnings.alias("warnings"), "infos", F.when(blockers > 0, "blocked").when(warnings > 0, "ready_with_warnings").otherwise("ready").alias("status"))


def record_warnings(role: Column, day: Column, authors: Column, commission: Column, decision: Column, decision_date: Column, needs_ocr: Column) -> Column:
    """What a motion's record lacks for its role, sorted."""
    role = F.coalesce(role, F.lit(""))
    none = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    return issues(
        {
            "authors_missing": F.coalesce(F.size(authors), F.lit(0)) <= 0, "commission_missing_for_report": role.contains("report") & none(commission), "decision_date_missing": role.contains("decision") & none(decision_date),
            "decision_missing_for_decision_document": role.contains("decision") & none(decision), "document_date_missing": none(day), "ocr_required": F.coalesce(needs_ocr, F.lit(False)),
        }
    )


def field_classes(base: dict[str, Column], extra: Column, pairs: dict[str, str]) -> Column:
    """How the fields of a record compare with those of its additional metadata (a map): an array of structs of field and class: absent, duplicate or contradiction."""
    one = lambda field, other: F.struct(
        F.lit(field).alias("field"), F.when(~F.map_contains_key(extra, other), "absent").when(F.lower(compact(F.coalesce(base[field], F.lit("")))) == F.lower(compact(F.coalesce(F.try_element_at(extra, F.lit(other)), F.lit("")))), "duplicate").otherwise("contradiction").alias("class")
    )
    return F.array(*[one(a, b) for a, b in pairs.items()])


def load_violations(inputs: DataFrame, vectors: DataFrame, dimension: int, prefix: str, category: str) -> DataFrame:
    """What speaks against loading: ids without counterpart, vectors of another dimension, ids without the prefix, another category; ``rule`` and ``rows``."""
    missing = same_ids(inputs, vectors, "chunk_id").select(F.concat(F.lit("only_"), "side").alias("rule"))
    of_vectors = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).select(F.lit("dimension").alias("rule"))
    of_inputs = inputs.select(F.explode(F.filter(F.array(F.when(~F.startswith("chunk_id", F.lit(prefix)), "prefix"), F.when(~F.col("category").eqNullSafe(F.lit(category)), "category")), lambda x: x.isNotNull())).alias("rule"))
    return missing.unionByName(of_vectors).unionByName(of_inputs).groupBy("rule").agg(F.count("*").alias("rows"))


def regression(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether searches give what they should: ``case_id``, the four checks and ``passed``.

    ``results`` has ``case_id``, ``place``, ``document_id``, ``commune`` and
    ``url``; ``cases`` has ``case_id``, ``expected`` (any of these ids, none if
    empty), ``forbidden`` (prefixes) and ``commune``.  A search without results
    fails its sources.
    """
    joined = cases.join(results.withColumn("found", F.coalesce("commune", F.lit(""))).drop("commune"), "case_id", "left")
    forbidden = F.exists("forbidden", lambda p: F.col("document_id").startswith(p))
    checks = joined.groupBy("case_id").agg(
        F.coalesce(F.bool_or((F.size("expected") == 0) | F.array_contains("expected", F.col("document_id"))), F.bool_or(F.size("expected") == 0)).alias("expected_found"),
        F.coalesce(~F.bool_or(forbidden), F.lit(True)).alias("forbidden_absent"), F.coalesce(F.bool_and(F.col("found") == F.col("commune")), F.lit(True)).alias("one_commune"),
        F.coalesce(F.bool_and(F.coalesce(F.nullif("url", F.lit("")), F.lit("https://")).startswith("https://")) & F.bool_or(F.coalesce("url", F.lit("")) != ""), F.lit(False)).alias("https_sources"),
    )
    return checks.withColumn("passed", F.col("expected_found") & F.col("forbidden_absent") & F.col("one_commune") & F.col("https_sources"))


def hits(paths: Column, expected: Column) -> Column:
    """Whether one of the paths contains an expected one, or the other way round, without file endings."""
    bare = lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"\.(?:txt|pdf|json)$", "")
    return F.exists(F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.exists(expected, lambda e: bare(p).contains(bare(e)) | bare(e).contains(bare(p))))


def number_conflict(listed: Column, named: Column) -> Column:
    """Whether two numbers of one document are known and differ."""
    return listed.isNotNull() & named.isNotNull() & (listed != named)
