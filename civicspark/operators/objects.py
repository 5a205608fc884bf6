"""Political objects, their responses and sessions: links by stored ids, deduplication, assembly of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions import dates, records
from civicspark.functions.text import fold, normalized_words


def matched_entries(objects: DataFrame, entries: DataFrame, links: DataFrame, responses: DataFrame) -> DataFrame:
    """The response entries of each object, each with the linked response document it belongs to.

    ``objects`` has ``object_id``; ``entries`` has ``object_id``, ``entry_no``,
    ``response_number``, ``adoption_date`` and ``entry_date``; ``links`` has
    ``object_id``, ``position`` and ``response_id``; ``responses`` has
    ``response_id`` (unique) and ``numbers``, those of its own entries.  An
    object without entries has those of its linked responses.  An entry belongs
    to the first linked document, in order of the links, that has its number,
    any if it has none; else to the only linked one; else to none (null).
    Links to documents that don't exist don't count.
    """
    linked = links.join(responses.select("response_id", F.coalesce("numbers", F.array().cast("array<string>")).alias("numbers")), "response_id").select("object_id", "position", "response_id", "numbers")
    own = objects.select("object_id").join(entries, "object_id")
    null = F.lit(None).cast("string")
    taken_over = linked.join(entries.select("object_id").distinct(), "object_id", "left_anti").join(objects.select("object_id"), "object_id", "left_semi").select(
        "object_id", "position", F.posexplode("numbers").alias("i", "response_number")
    ).select("object_id", F.struct("position", "i").alias("order"), "response_number", null.alias("adoption_date"), null.alias("entry_date"))
    given = own.select("object_id", F.struct(F.col("entry_no").cast("int").alias("position"), F.lit(0).alias("i")).alias("order"), "response_number", "adoption_date", "entry_date")
    all_ = given.unionByName(taken_over.withColumn("order", F.struct(F.col("order.position").cast("int").alias("position"), F.col("order.i").alias("i"))))
    all_ = all_.withColumn("entry_no", F.row_number().over(Window.partitionBy("object_id").orderBy("order")) - 1)
    plain = F.coalesce("response_number", F.lit("")) == ""
    best = (
        all_.select("object_id", "entry_no", "response_number").join(linked, "object_id").where(plain | F.expr("array_contains(numbers, response_number)"))
        .groupBy("object_id", "entry_no").agg(F.min_by("response_id", F.struct("position", "response_id")).alias("numbered"))
    )
    only = linked.groupBy("object_id").agg(F.count("*").alias("n"), F.min("response_id").alias("only")).where("n = 1").select("object_id", "only")
    return (
        all_.join(best, ["object_id", "entry_no"], "left").join(only, "object_id", "left")
        .select("object_id", "entry_no", "response_number", "adoption_date", "entry_date", F.coalesce("numbered", "only").alias("response_id"))
    )


def answered(objects: DataFrame, entries: DataFrame, links: DataFrame, responses: DataFrame, towns: Sequence[str] = (), year: str | None = None) -> DataFrame:
    """One row for each answered object: the first of its entries, of the year asked for.

    ``responses`` also has ``role``, ``text`` (the beginning of its letter),
    ``document_date``, ``listing_year`` and ``reference``.  Gives
    ``object_id``, ``response_id``, ``response_number``, ``response_date``,
    ``response_year`` and ``reference``.
    """
    held = matched_entries(objects, entries, links, responses).join(responses.drop("numbers"), "response_id", "left")
    letter = records.letter_date(F.col("text"), F.col("role"), towns) if towns else F.lit(None).cast("string")
    official = dates.official_date(letter, F.col("adoption_date"), F.col("entry_date"))
    dated = held.withColumn("response_date", official).withColumn(
        "response_year", records.response_year(official, F.col("document_date"), F.lit(None).cast("string"), F.col("listing_year").cast("string"), F.col("response_number"))
    )
    asked = dated.where(F.col("response_year") == year) if year else dated
    reference = F.coalesce(F.nullif(F.col("reference"), F.lit("")), "response_number")
    kept = asked.select("object_id", "entry_no", F.struct("response_id", "response_number", "response_date", "response_year", reference.alias("reference")).alias("x"))
    return kept.groupBy("object_id").agg(F.min_by("x", "entry_no").alias("x")).select("object_id", "x.*")


def unanswered(objects: DataFrame, links: DataFrame, responses: DataFrame, year: str | None = None) -> DataFrame:
    """Objects none of whose links leads to an existing document; ``year`` is that of filing.

    ``objects`` has ``object_id``, ``political_date`` and ``listing_year``.
    """
    real = links.join(responses.select("response_id"), "response_id", "left_semi").select("object_id")
    rows = objects.join(real, "object_id", "left_anti").withColumn("filed", records.filing_year(F.col("political_date"), F.col("listing_year").cast("string")))
    return (rows.where(F.col("filed") == year) if year else rows).select("object_id", "political_date", "filed")


def answered_flagged(objects: DataFrame, links: DataFrame, responses: DataFrame, towns: Sequence[str] = (), year: str | None = None) -> DataFrame:
    """Objects that are flagged as answered, with the first linked response that exists; ``has_response`` that is null is false."""
    first = links.join(responses, "response_id").groupBy("object_id").agg(F.min_by(F.struct("response_id", "role", "text"), F.struct("position", "response_id")).alias("x")).select("object_id", "x.*")
    letter = records.letter_date(F.col("text"), F.col("role"), towns) if towns else F.lit(None).cast("string")
    rows = objects.where(F.coalesce("has_response", F.lit(False))).join(first, "object_id").withColumn("response_date", dates.official_date(letter, F.lit(""), F.col("response_date")))
    return (rows.where(F.startswith("response_date", F.lit(year))) if year else rows).select("object_id", "response_id", "response_date")


def unanswered_flagged(objects: DataFrame, year: str | None = None) -> DataFrame:
    """Objects that aren't flagged as answered, with the year of filing."""
    rows = objects.where(~F.coalesce("has_response", F.lit(False))).withColumn("filed", records.filing_year(F.col("deposit_date"), F.col("listing_year").cast("string")))
    return (rows.where(F.col("filed") == year) if year else rows).select("object_id", "filed")


# ---- deduplication ----------------------------------------------------------------------------------------------


def deduplicated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of one role with the same content once, and the copies that were dropped.

    ``documents`` has ``document_id``, ``role``, ``text``, ``byte_hash``,
    ``day`` and ``object_id``.  Content is the hash of the words where there
    are 120 characters of them, else that of the bytes.  The latest one stays
    (ties: the larger id), with the sorted ids of all objects; copies name the
    one that stayed.
    """
    words = normalized_words(F.coalesce("text", F.lit("")))
    keyed = documents.withColumn("identity", F.when(F.length(words) >= 120, F.sha2(words, 256)).otherwise(F.col("byte_hash")))
    best = keyed.groupBy("role", "identity").agg(F.max(F.struct(F.coalesce("day", F.lit("")).alias("day"), F.col("document_id"))).alias("best"), F.array_sort(F.collect_set("object_id")).alias("object_ids")).select("role", "identity", F.col("best.document_id").alias("kept"), "object_ids")
    copies = keyed.select("role", "identity", "document_id").distinct().join(best, ["role", "identity"]).where("document_id <> kept").select("document_id", "kept")
    return best.select(F.col("kept").alias("document_id"), "role", "object_ids"), copies


#: Which type of attachment stays of several with the same content (fixed values).
TYPE_RANK = {"Réponse": 3, "Annexe": 2, "Interpellation": 1}


def attachments_once(attachments: DataFrame) -> DataFrame:
    """Of an object's attachments with the same content the one of the highest type, then of the largest id, with the ids of the others.

    ``attachments`` has ``object_id``, ``content_hash``, ``type`` and ``download_id``.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv]), F.col("type")), F.lit(0))
    grouped = attachments.groupBy("object_id", "content_hash").agg(F.max(F.struct(rank.alias("rank"), "download_id", "type")).alias("best"), F.collect_set("download_id").alias("ids"))
    return grouped.select("object_id", "content_hash", F.col("best.download_id").alias("download_id"), F.col("best.type").alias("type"), F.array_sort(F.array_except("ids", F.array("best.download_id"))).alias("aliases"))


def primary_attachment(attachments: DataFrame) -> DataFrame:
    """The attachment that is an object's response: of the type ``préavis``, else named a report, else the first."""
    rank = F.when(normalized_words(F.coalesce("type", F.lit(""))) == "preavis", 0).when(normalized_words(F.coalesce("name", F.lit(""))).contains("rapport"), 1).otherwise(2)
    return attachments.groupBy("object_id").agg(F.min_by("download_id", F.struct(rank, "position", "download_id")).alias("download_id"))


def candidate_reason(reference: Column, title: Column) -> Column:
    """Why a document may be a response: its reference, its title, or null."""
    t = fold(F.coalesce(title, F.lit("")))
    named = t.rlike(r"\breponse\s+(?:municipale\s+)?a\s+l.?interpellation\b") | (t.contains("interpellation") & t.contains("reponse"))
    return F.when(F.coalesce(reference, F.lit("")).rlike(r"(?i)(?:^|/)RI\s*0*\d+\b"), "ri_reference").when(named, "response_title")


def split_candidates(documents: DataFrame, reason: Column, rejected: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with a reason to be taken, and the others with the reason they are rejected for."""
    judged = documents.withColumn("reason", reason)
    return judged.where("reason is not null"), judged.where("reason is null").withColumn("reason", rejected)


def first_source_wins(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of tables, each key once, from the first table that has it."""
    out = None
    for i, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in sources[0].columns if c != key]
    return out.groupBy(key).agg(F.min(F.struct("__source", *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest], F.col("x.__source").alias("source_no"))


def last_source_wins(sources: Sequence[DataFrame], keys: list[Column]) -> DataFrame:
    """The union of listings, one row for each combination of keys (such as id or URL, date, title), from the last listing that has it."""
    out = None
    for i, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = out.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    return keyed.groupBy(*names).agg(F.max(F.struct("__source", *sources[0].columns)).alias("x")).select("x.*").withColumnRenamed("__source", "source_no")


# ---- links and assembly -----------------------------------------------------------------------------------------


def canonical_objects(links: DataFrame, records_: DataFrame) -> DataFrame:
    """The canonical object that a link leads to.

    ``links`` has ``link_id``, ``url`` and ``related_id``; ``records_`` has
    ``url``, ``object_id``, ``canonical`` and ``related_id``.  A URL leads to
    the canonical record that has it, or through another record that has it to
    the canonical one this is related to; else the link's own relation counts.
    Gives ``link_id``, ``object_id`` and ``way`` (url, indirect, id).
    """
    canonical = records_.where("canonical and object_id is not null")
    ids = canonical.select("object_id").distinct()
    direct = canonical.where("url is not null").groupBy("url").agg(F.max("object_id").alias("by_url"))
    over = records_.where("not coalesce(canonical, false) and url is not null and related_id is not null").select("url", F.col("related_id").alias("object_id")).join(ids, "object_id", "left_semi").groupBy("url").agg(F.max("object_id").alias("by_other"))
    known = ids.select(F.col("object_id").alias("related_id"), F.col("object_id").alias("by_id"))
    found = links.join(direct, "url", "left").join(over, "url", "left").join(known, "related_id", "left")
    # a record that is related overrides the URL's own, as it is read later
    return found.select("link_id", F.coalesce("by_other", "by_url", "by_id").alias("object_id"), F.when(F.col("by_other").isNotNull(), "indirect").when(F.col("by_url").isNotNull(), "url").when(F.col("by_id").isNotNull(), "id").alias("way")).where("object_id is not null")


def recovered_downloads(failed: DataFrame, documents: DataFrame) -> DataFrame:
    """Failed downloads with the document that has the same title, folded; of several the last by id."""
    by_title = documents.select(normalized_words(F.col("title")).alias("key"), "document_id").where("key <> ''").groupBy("key").agg(F.max("document_id").alias("equivalent_id"))
    return failed.withColumn("key", normalized_words(F.col("title"))).join(by_title, "key", "left").drop("key")


def hinted_authors(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """The author of the first hint, by position, whose text stands in a document's folded title; ``hints`` is a bounded table kept by hand."""
    given = hints.select("position", fold(F.col("hint")).alias("hint"), "author").where("hint <> ''")
    rows = given.agg(F.array_sort(F.collect_list(F.struct("position", "hint", "author"))).alias("hints"))
    return documents.join(F.broadcast(rows)).select("document_id", F.get(F.filter("hints", lambda h: fold(F.col("title")).contains(h["hint"])), F.lit(0))["author"].alias("author"))


def inherited(documents: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """Documents with authors and title of the object they are linked to where they lack them, and whether they are linked."""
    held = links.join(objects.select("object_id", F.col("authors").alias("o_authors"), F.col("title").alias("o_title")), "object_id")
    return documents.join(held, "document_id", "left").select(
        "document_id", F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, F.col("authors")).otherwise(F.col("o_authors")).alias("authors"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), "o_title").alias("title"), "object_id", F.col("object_id").isNotNull().alias("agenda_linked"),
    )


def sessions(agenda: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions with their agenda: ``session_id`` and ``items``, structs of number, title and the linked documents' ids and titles in order.

    ``agenda`` has ``session_id``, ``number`` and ``title``; ``links`` has
    ``session_id``, ``number``, ``position`` and ``document_id``; links to
    unknown documents are left out, items without links stay.
    """
    linked = links.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id")
    per_item = linked.groupBy("session_id", "number").agg(F.array_sort(F.collect_list(F.struct("position", "document_id", "document_title"))).alias("ds"))
    item = F.struct("number", "title", F.transform(F.coalesce("ds", F.array().cast("array<struct<position:int,document_id:string,document_title:string>>")), lambda x: F.struct(x["document_id"].alias("document_id"), x["document_title"].alias("title"))).alias("documents"))
    return agenda.join(per_item, ["session_id", "number"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def flattened(sessions_: DataFrame, categories: dict[str, str]) -> DataFrame:
    """A row for each document of each item of each session, its category in normal form."""
    normal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), fold(F.regexp_extract("d.title", r"^(\S+)", 1))), F.lit("autre"))
    items = sessions_.select("session_id", F.explode("items").alias("i")).select("session_id", "i.number", F.explode("i.documents").alias("d"))
    return items.select("session_id", "number", "d.document_id", normal.alias("category"))


def occurrences(mentions: DataFrame, legislature: tuple[str, str]) -> DataFrame:
    """For each object the sessions it is mentioned in within a legislature, sorted, with the first (deposit) and the last one.

    ``mentions`` has ``object_id``, ``day`` and ``url``; repeated mentions count once.
    """
    inside = mentions.where(F.col("day").between(*legislature)).select("object_id", "day", "url").distinct()
    return inside.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("day", "url"))).alias("sessions")).select(
        "object_id", "sessions", F.get("sessions", F.lit(0))["day"].alias("deposited"), F.element_at("sessions", -1)["day"].alias("considered")
    )


def session_references(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects with their session references, structs of day and item, the new ones added, each once, in order."""
    added = new.groupBy("object_id").agg(F.collect_set(F.struct("day", "item")).alias("added"))
    none = F.array().cast("array<struct<day:string,item:string>>")
    return objects.join(added, "object_id", "left").select("object_id", F.array_sort(F.array_union(F.coalesce("sessions", none), F.coalesce("added", none))).alias("sessions"))


def fan_out(objects: DataFrame, responses: DataFrame) -> DataFrame:
    """The documents of an object: one for its own text, and one for each response, of its PDF or, where there is none, of its HTML.

    ``responses`` has ``object_id``, ``no``, ``pdf_url`` and ``html``; one with
    neither makes no document.
    """
    own = objects.select("object_id", F.concat("object_id", F.lit("_text")).alias("document_id"), F.lit("object_text").alias("role"), F.lit(None).cast("string").alias("pdf_url"))
    pdf = F.nullif("pdf_url", F.lit(""))
    each = responses.where(pdf.isNotNull() | (F.coalesce("html", F.lit("")) != "")).select(
        "object_id", F.format_string("%s_response_%02d", F.col("object_id"), F.col("no")).alias("document_id"), F.when(pdf.isNotNull(), "municipal_response").otherwise("municipal_response_html").alias("role"), pdf.alias("pdf_url")
    )
    return own.unionByName(each)


def relationships(documents: DataFrame) -> DataFrame:
    """For each object key the documents by what they are: text, responses, reports, decisions; arrays of ids in order."""
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("document_id"))))
    role = F.col("document_role")
    return documents.groupBy("object_key").agg(
        F.min(F.when(role.endswith("_text"), F.col("document_id"))).alias("object_id"), ids(role == "municipal_response").alias("response_ids"), ids(role.contains("report")).alias("report_ids"), ids(role.contains("decision")).alias("decision_ids")
    )


def metadata_records(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """The JSON record of each document: its own fields without empty ones, its dates' year and its relations."""
    own = documents.join(relations, "object_key", "left")
    base = F.struct("document_id", F.nullif("title", F.lit("")).alias("title"), "category", "document_role", "document_date", F.left("document_date", F.lit(4)).alias("document_year"))
    related = F.struct(F.when(F.col("object_id") != F.col("document_id"), F.col("object_id")).alias("object_id"), F.when(F.size("response_ids") > 0, F.col("response_ids")).alias("response_document_ids"))
    return own.select("document_id", F.to_json(F.struct(base.alias("document_metadata"), related.alias("relationships"))).alias("record"))


def merged_links(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects with the responses that were linked to them, best first: ``responses`` (structs of id, score, tier) and ``link_status``."""
    each = links.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("response_id").alias("response_id"), "score", "tier"))).alias("ls"))
    none = F.array().cast("array<struct<order:double,response_id:string,score:double,tier:string>>")
    joined = objects.join(each, "object_id", "left").withColumn("ls", F.coalesce("ls", none))
    return joined.select("object_id", F.transform("ls", lambda x: x["response_id"]).alias("response_ids"), F.when(F.exists("ls", lambda x: x["tier"] == "exact"), "exact").when(F.exists("ls", lambda x: x["tier"] == "probable"), "probable").when(F.size("ls") > 0, "manual").otherwise("none").alias("link_status"))


def document_key(fields: Sequence[Column], result_id: Column) -> Column:
    """The first of the fields that is known and not empty, else the result's id up to its ``#``."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.element_at(F.split(result_id, "#"), 1))


def context(results: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """The passages for an answer, grouped by document in order of its best score: one row with ``context``.

    ``results`` has ``document_id``, ``title``, ``commune``, ``score``,
    ``place`` and ``content``, a bounded set of a search's results.
    """
    each = F.array_sort(F.collect_list(F.struct("place", "content")))
    docs = results.groupBy("document_id").agg(F.max("score").alias("score"), F.min("place").alias("place"), F.first("title").alias("title"), F.first("commune").alias("commune"), each.alias("ps"))
    passages = F.array_join(F.transform("ps", lambda p, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(":\n"), p["content"])), "\n\n")
    blocks = docs.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "place", F.coalesce("title", F.lit("document")).alias("title"), F.coalesce("commune", F.lit("commune non précisée")).alias("commune"), passages.alias("passages")))).alias("bs"))
    text = F.transform("bs", lambda b, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), b["title"], F.lit(" | Commune: "), b["commune"], F.lit("\n"), b["passages"]))
    return blocks.select(F.array_join(text, separator).alias("context"))


def with_summaries(results: DataFrame, stored: DataFrame, fallback: Column) -> DataFrame:
    """Results with their stored summary; where it is missing or blank, ``fallback``; ids and order stay."""
    return results.join(stored.select("document_id", "summary"), "document_id", "left").withColumn("summary", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), fallback))


def document_specs(curated: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Curated documents and those of the catalogue that aren't among them, by URL; ``origin`` tells which."""
    own = curated.withColumn("origin", F.lit("curated"))
    rest = catalogue.join(curated.select("url").distinct(), "url", "left_anti").dropDuplicates(["url"]).withColumn("origin", F.lit("catalogue"))
    return own.unionByName(rest)


def schema_fields(df: DataFrame) -> list[tuple[str, str, bool]]:
    """The JSON schema's fields of a table: name, type and whether a row lacks it."""
    kinds = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean"}
    lacks = df.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return [(name, kinds.get(kind, "array" if kind.startswith("array") else "object"), bool(lacks[name])) for name, kind in df.dtypes]


def publication(needs_ocr: Column, tier: Column) -> Column:
    """``validated`` if no text recognition is needed and the link is exact or probable, else ``needs_review``."""
    return F.when(~F.coalesce(needs_ocr, F.lit(True)) & F.coalesce(tier, F.lit("")).isin("exact", "probable"), "validated").otherwise("needs_review")
