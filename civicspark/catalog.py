"""The core's queries, each with the operators it covers and SQL that gives the same rows.

An entry is (operators, query, SQL or None).  Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions import dates, text
from civicspark.operators import browse, dedup, linkage, quality, retrieval, segment, snapshots, store
from civicspark.plans import question
from civicspark.sources import html
from civicspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[str, Query, str | None]] = {}

#: Accents and base letters, for SQL.
_FOLD = f"lower(translate({{0}}, '{text.MARKED}', '{text.BASE}'))"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x{{A0}}\\x{{2007}}\\x{{202F}}]+'), lambda w: w <> '')"


def _fold(c: str) -> str:
    return _FOLD.format(c)


def _words(c: str) -> str:
    return _WORDS.format(c)


def _subject(c: str) -> str:
    """The words of a title's subject, as an array, in SQL; see ``linkage.title_key``."""
    f = _fold(c)
    phrase = f"list_last(regexp_extract_all({f}, '[«\"]\\s*([^»\"]{{8,}}?)\\s*[»\"]', 1))"
    bare = f"regexp_replace(regexp_replace(coalesce({phrase}, regexp_replace({f}, '\\.pdf$', '')), '\\bri\\s*\\d+\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')"
    return f"list_filter(string_split({bare}, ' '), lambda w: w <> '' AND NOT list_contains({linkage.EMPTY_WORDS}, w) AND NOT regexp_matches(w, '^20\\d\\d$'))"


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CATALOG[name] = (covers, f, sql)
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_metadata")


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks")


def c(name: str) -> Column:
    return F.col(name)


# ---- listings, filters, counts --------------------------------------------------------------------------------


@query("browse_documents", "S1 F7 F10-F14 O1 O2 V15", """
    SELECT document_id, year, commune, category, title FROM (
      SELECT *, coalesce(nullif(cast(listing_year AS VARCHAR), ''), nullif(left(document_date, 4), '')) AS year FROM document_metadata)
    WHERE coalesce(document_role, '') NOT IN ('municipal_response','response','status_report','council_decision','consideration_report','commission_report')
      AND category IN ('interpellation', 'postulat') AND year BETWEEN '2022' AND '2024'
      AND (coalesce(title ILIKE '%patrimoine%', false) OR coalesce(source_title ILIKE '%patrimoine%', false))
    ORDER BY year DESC NULLS LAST, commune ASC NULLS LAST, title ASC NULLS LAST, document_id LIMIT 2000""")
def _(s, d):
    return browse.browse(docs(s, d), categories=["interpellations", "postulats"], keywords=["patrimoine"], year_from="2022", year_to="2024", limit=5000)


@query("filter_conjunction", "F1-F3 F5", "SELECT document_id, category, listing_year FROM document_metadata WHERE commune = 'Châtel-Névis' AND category = 'postulat' AND cast(listing_year AS VARCHAR) = '2025'")
def _(s, d):
    return docs(s, d).where(browse.filters({"city": "Châtel-Névis", "doc_type": "postulats", "year": 2025})).select("document_id", "category", "listing_year")


@query("filter_relaxed", "F6", """
    WITH a AS (SELECT document_id, commune FROM document_metadata WHERE commune = 'Vérandes' AND category = 'motion') SELECT * FROM a UNION ALL SELECT document_id, commune FROM document_metadata WHERE commune = 'Vérandes' AND NOT EXISTS (SELECT * FROM a)""")
def _(s, d):
    spec = {"city": "Vérandes", "doc_type": "motions", "year": 1999}
    for stage in [spec, *browse.relaxed(spec)]:
        rows = docs(s, d).where(browse.filters(stage))
        if not rows.isEmpty():
            break
    return rows.select("document_id", "commune")


@query("roles_null_kept", "F7", "SELECT document_id, document_role FROM document_metadata WHERE coalesce(document_role, '') <> 'municipal_response'")
def _(s, d):
    return docs(s, d).where(F.coalesce("document_role", F.lit("")) != "municipal_response").select("document_id", "document_role")


@query("roles_null_dropped", "F8", "SELECT document_id, document_role FROM document_metadata WHERE document_role <> 'municipal_response'")
def _(s, d):
    return docs(s, d).where(c("document_role") != "municipal_response").select("document_id", "document_role")


@query("json_filter", "F1 X1 X2", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("json_defaults", "F9 F17 F18", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(CAST(json_extract_string(props, '$.canonical') AS BOOLEAN), true)) AS canonical, count(*) FILTER (WHERE json_exists(props, '$.k')) AS with_key FROM events GROUP BY event_type")
def _(s, d):
    canonical = F.coalesce(F.get_json_object("props", "$.canonical").cast("boolean"), F.lit(True))
    return browse.counts_by(table(s, d, "events"), ["event_type"], {"canonical": canonical, "with_key": F.array_contains(F.json_object_keys("props"), "k")})


@query("json_built", "X4 X5 K16", "SELECT chunk_id, left(regexp_replace(content, '[\\r\\n]+', ' ', 'g'), 220) AS excerpt, length(content) AS chars FROM chunks")
def _(s, d):
    built = chunks(s, d).select(F.to_json(F.struct("chunk_id", text.excerpt(c("content")).alias("excerpt"), F.length("content").alias("chars"))).alias("j"))
    return built.select(F.from_json("j", "chunk_id string, excerpt string, chars bigint").alias("x")).select("x.*")


@query("keywords_all_fields", "F14 F15 F16", """
    SELECT d.document_id, c.chunk_id FROM chunks c JOIN (SELECT DISTINCT document_id, title FROM document_metadata) d USING (document_id)
    WHERE (coalesce(d.title ILIKE '%école%', false) OR coalesce(c.content ILIKE '%école%', false)) AND (coalesce(d.title ILIKE '%crédit%', false) OR coalesce(c.content ILIKE '%crédit%', false))""")
def _(s, d):
    titled = docs(s, d).select("document_id", "title").distinct()
    return chunks(s, d).join(titled, "document_id").where(text.matches_keywords(["école", "crédit"], c("title"), c("content"))).select("document_id", "chunk_id")


@query("id_prefix", "F19 F20 A2", "SELECT commune_key, count(*) AS n, count(*) FILTER (WHERE starts_with(document_id, commune_key || '_') OR starts_with(document_id, replace(commune_key, '-', '_') || '_')) AS own FROM document_metadata GROUP BY commune_key")
def _(s, d):
    own = F.startswith("document_id", F.concat("commune_key", F.lit("_"))) | F.startswith("document_id", F.concat(F.replace("commune_key", F.lit("-"), F.lit("_")), F.lit("_")))
    return browse.counts_by(docs(s, d), ["commune_key"], {"own": own})


@query("legislature_window", "F23", "SELECT document_id, coalesce(document_date, '9999') AS day FROM document_metadata WHERE coalesce(document_date, '9999') BETWEEN '2021-07-01' AND '2026-06-30'")
def _(s, d):
    return docs(s, d).select("document_id", F.coalesce("document_date", F.lit("9999")).alias("day")).where("day between '2021-07-01' and '2026-06-30'")


@query("readiness", "F24 A1 A3 K6", "SELECT count(embedding) > 0 AS ready, count(*) AS chunks, count(embedding) AS vectors, min(len(embedding)) AS least, max(len(embedding)) AS most FROM chunks")
def _(s, d):
    return chunks(s, d).agg((F.count("embedding") > 0).alias("ready"), F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"))


@query("counts_by_year", "A1 A2 A4", "SELECT listing_year, count(*) AS n, count(*) FILTER (WHERE document_role = 'municipal_response') AS responses, count(*) FILTER (WHERE document_role LIKE '%\\_text' ESCAPE '\\') AS texts FROM document_metadata GROUP BY listing_year")
def _(s, d):
    return browse.counts_by(docs(s, d), ["listing_year"], {"responses": c("document_role") == "municipal_response", "texts": c("document_role").endswith("_text")})


@query("distinct_projection", "A5", "SELECT DISTINCT category, document_role, processing_status FROM document_metadata")
def _(s, d):
    return docs(s, d).select("category", "document_role", "processing_status").distinct()


@query("document_text", "A6 J3", """
    SELECT m.document_id, coalesce(t.content, '') AS content FROM (SELECT DISTINCT document_id FROM document_metadata) m LEFT JOIN (
      SELECT document_id, string_agg(content, ' ' ORDER BY chunk_index) AS content FROM (SELECT document_id, chunk_index, min(content) AS content FROM chunks GROUP BY ALL) GROUP BY document_id) t USING (document_id)""")
def _(s, d):
    once = chunks(s, d).groupBy("document_id", "chunk_index").agg(F.min("content").alias("content"))
    joined = once.groupBy("document_id").agg(F.expr("listagg(content, ' ') within group (order by chunk_index)").alias("content"))
    return docs(s, d).select("document_id").distinct().join(joined, "document_id", "left").select("document_id", F.coalesce("content", F.lit("")).alias("content"))


@query("author_listing", "A7 J2 X6 Z35", "SELECT DISTINCT document_id, a.name AS name, a.party AS party, a.civility AS civility, a.role AS role FROM (SELECT document_id, unnest(authors) AS a FROM document_metadata) WHERE a.name IS NOT NULL")
def _(s, d):
    return browse.author_listing(docs(s, d))


@query("authors_by_document", "A8 X7", "SELECT document_id, string_agg(name, ', ' ORDER BY name) AS authors, count(*) AS n FROM (SELECT DISTINCT document_id, a.name AS name FROM (SELECT document_id, unnest(authors) AS a FROM document_metadata) WHERE a.name IS NOT NULL) GROUP BY document_id")
def _(s, d):
    return browse.authors_by_document(docs(s, d))


@query("author_display", "T15 T19", """
    SELECT DISTINCT a.name AS name, a.party AS party, CASE WHEN a.party IS NOT NULL AND NOT contains(h, '(' || a.party) THEN h || ' (' || a.party || ')' ELSE h END AS shown
    FROM (SELECT a, CASE WHEN a.civility IS NOT NULL AND NOT starts_with(a.name, a.civility) THEN a.civility || ' ' || a.name ELSE a.name END AS h FROM (SELECT unnest(authors) AS a FROM document_metadata)) WHERE a.name IS NOT NULL""")
def _(s, d):
    people = docs(s, d).select(F.explode("authors").alias("a")).select("a.*").where("name is not null")
    return people.select("name", "party", text.author_display(c("civility"), c("name"), c("party")).alias("shown")).distinct()


@query("author_parts", "T19", """
    SELECT DISTINCT name, CASE WHEN t IN ('M.', 'Monsieur') THEN 'M.' WHEN t <> '' THEN 'Mme' END AS civility, nullif(regexp_extract(name, '^\\s*(?:(M\\.|Mme|Mlle|Monsieur|Madame)\\s+)?([^()]+?)\\s*(?:\\(([^)]+)\\))?\\s*$', 2), '') AS person,
      nullif(regexp_extract(name, '^\\s*(?:(M\\.|Mme|Mlle|Monsieur|Madame)\\s+)?([^()]+?)\\s*(?:\\(([^)]+)\\))?\\s*$', 3), '') AS party
    FROM (SELECT a.name AS name, regexp_extract(a.name, '^\\s*(?:(M\\.|Mme|Mlle|Monsieur|Madame)\\s+)?([^()]+?)\\s*(?:\\(([^)]+)\\))?\\s*$', 1) AS t FROM (SELECT unnest(authors) AS a FROM document_metadata) WHERE a.name IS NOT NULL)""")
def _(s, d):
    names = docs(s, d).select(F.explode("authors").alias("a")).select(c("a.name").alias("name")).where("name is not null").distinct()
    parts = text.author_parts(c("name"))
    return names.select("name", parts["civility"].alias("civility"), parts["name"].alias("person"), parts["party"].alias("party"))


@query("authors_in_all_types", "A20 U2", """
    SELECT name, count(*) AS labels FROM (SELECT DISTINCT a.name AS name, category FROM (SELECT category, unnest(authors) AS a FROM document_metadata WHERE category IN ('interpellation', 'postulat', 'motion')) WHERE a.name IS NOT NULL) GROUP BY name HAVING count(*) >= 3""")
def _(s, d):
    rows = docs(s, d).where(c("category").isin("interpellation", "postulat", "motion")).select("category", F.explode("authors").alias("a")).select(c("a.name").alias("name"), "category").where("name is not null")
    return linkage.overlap_in_all(rows, ["name"], "category", 3)


@query("category_report", "A11", """
    SELECT commune_key, count(DISTINCT document_id) AS documents, count(*) AS chunks, count(*) FILTER (WHERE len(quality_issues) > 0) AS review, count(*) FILTER (WHERE coalesce(len(quality_issues), 0) = 0) AS valid, bool_and(word_count > 0) AS all_counted
    FROM chunks GROUP BY commune_key""")
def _(s, d):
    issues = F.coalesce(F.size("quality_issues"), F.lit(0))
    return chunks(s, d).groupBy("commune_key").agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.size("quality_issues") > 0).alias("review"), F.count_if(issues <= 0).alias("valid"), F.bool_and(c("word_count") > 0).alias("all_counted")
    )


@query("issue_histogram", "A12 A17", "SELECT issue, count(*) AS n FROM (SELECT unnest(quality_issues) AS issue FROM chunks) GROUP BY issue")
def _(s, d):
    return quality.histogram(chunks(s, d), "quality_issues")


@query("first_last_by_type", "A14", "SELECT category, count(DISTINCT document_id) AS n, min(document_date) AS first_day, max(document_date) AS last_day FROM document_metadata GROUP BY category")
def _(s, d):
    return docs(s, d).groupBy("category").agg(F.count_distinct("document_id").alias("n"), F.min("document_date").alias("first_day"), F.max("document_date").alias("last_day"))


@query("rounded_mean", "A19", "SELECT commune_key, round(avg(word_count), 4) AS mean_words, count(word_count) AS counted FROM chunks GROUP BY commune_key")
def _(s, d):
    return chunks(s, d).groupBy("commune_key").agg(F.round(F.avg("word_count"), 4).alias("mean_words"), F.count("word_count").alias("counted"))


@query("numbered_maximum", "A21", """
    SELECT doc_id, list_max(list_transform(regexp_extract_all(text, 'CHF ([0-9]+)', 1), lambda x: CAST(x AS BIGINT))) AS largest, len(regexp_extract_all(text, '\\?')) AS questions FROM documents""")
def _(s, d):
    found = F.transform(F.regexp_extract_all("text", F.lit("CHF ([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return table(s, d, "documents").select("doc_id", F.array_max(found).alias("largest"), F.regexp_count("text", F.lit("\\?")).cast("bigint").alias("questions"))


@query("paged", "O7 O6", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def _(s, d):
    return browse.page(table(s, d, "documents"), [F.desc("n_chars"), c("doc_id")], 2).select("doc_id", "n_chars")


@query("recent", "O9", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def _(s, d):
    return table(s, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")


@query("available_types", "Z40", "SELECT DISTINCT document_type FROM (SELECT unnest(document_types) AS document_type FROM municipalities WHERE search_enabled AND label IN ('Vérandes', 'Aubrény'))")
def _(s, d):
    return browse.available_types(table(s, d, "municipalities"), ["Vérandes", "Aubrény"])


# ---- joins and links ------------------------------------------------------------------------------------------


@query("chunks_with_documents", "S2 J1 V5", "SELECT c.chunk_id, c.document_id, m.category, m.title FROM chunks c JOIN (SELECT document_id, max(category) AS category, max(title) AS title FROM document_metadata GROUP BY document_id) m USING (document_id) WHERE m.category = 'preavis'")
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("category").alias("category"), F.max("title").alias("title")).where("category = 'preavis'")
    return chunks(s, d).join(once, "document_id").select("chunk_id", "document_id", "category", "title")


@query("broken_links", "J5 J6 Z54", "SELECT l.l_orderkey AS l_orderkey, count(*) AS n FROM lineitem l ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey")
def _(s, d):
    orders = table(s, d, "orders").where("o_orderstatus <> 'F'")
    return linkage.broken_links(table(s, d, "lineitem").select("l_orderkey"), "l_orderkey", orders, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("id_bijection", "J7 U2", """
    SELECT document_id, 'left' AS side FROM (SELECT DISTINCT document_id FROM document_metadata) ANTI JOIN chunks USING (document_id)
    UNION ALL SELECT document_id, 'right' AS side FROM (SELECT DISTINCT document_id FROM chunks) ANTI JOIN document_metadata USING (document_id)""")
def _(s, d):
    return quality.same_ids(docs(s, d), chunks(s, d), "document_id")


@query("party_enrichment", "J15 J16", """
    SELECT p.name AS name, p.party AS party, count(DISTINCT d.document_id) AS documents FROM (SELECT DISTINCT document_id, a.name AS name FROM (SELECT document_id, unnest(authors) AS a FROM document_metadata) WHERE a.name IS NOT NULL) d
    LEFT JOIN (SELECT a.name AS name, max(a.party) AS party FROM (SELECT unnest(authors) AS a FROM document_metadata) GROUP BY a.name) p ON d.name = p.name GROUP BY ALL""")
def _(s, d):
    people = browse.author_listing(docs(s, d))
    party = people.groupBy("name").agg(F.max("party").alias("party"))
    return people.select("document_id", "name").distinct().join(party, "name", "left").groupBy("name", "party").agg(F.count_distinct("document_id").alias("documents"))


@query("object_graph", "J4 J17", """
    WITH r AS (SELECT DISTINCT document_id, document_role, regexp_extract(document_id, '^(.*_\\d+)_', 1) AS key FROM document_metadata WHERE regexp_extract(document_id, '^(.*_\\d+)_', 1) <> '')
    SELECT o.document_id AS object_id, a.document_id AS response_id FROM (SELECT * FROM r WHERE document_role IN ('interpellation_text','postulat_text','postulate_text','motion_text')) o LEFT JOIN (SELECT * FROM r WHERE document_role = 'municipal_response') a ON o.key = a.key""")
def _(s, d):
    return retrieval.responses(docs(s, d))


@query("token_overlap_links", "J11 R11", f"""
    WITH a AS (SELECT document_id, list_distinct(list_filter({_subject('t')}, lambda w: length(w) >= 4)) AS ws FROM (SELECT document_id, max(title) AS t FROM document_metadata GROUP BY document_id)), b AS (SELECT item_id, list_distinct(list_filter({_subject('question')}, lambda w: length(w) >= 4)) AS ws FROM eval_items),
    p AS (SELECT document_id, item_id, count(*) AS n FROM (SELECT document_id, unnest(ws) AS w FROM a) JOIN (SELECT item_id, unnest(ws) AS w FROM b) USING (w) GROUP BY ALL)
    SELECT document_id AS l, item_id AS r, n AS shared FROM p WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, item_id) = 1""")
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title")).withColumn("tokens", linkage.tokens(linkage.title_key(c("title"))))
    items = table(s, d, "eval_items").select(c("item_id"), linkage.tokens(linkage.title_key(c("question"))).alias("tokens"))
    return linkage.overlap_join(linkage.candidate_pairs(once, items, "document_id", "item_id", "tokens", "tokens", lambda _: F.lit(2)))


@query("title_coverage_links", "J12 J10", None)
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title"), F.max("source_title").alias("source_title"))
    pieces = chunks(s, d).groupBy("document_id", "chunk_index", "chunk_id").agg(F.max("content").alias("content")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("pieces"))
    texts = once.join(pieces, "document_id", "left").select(c("document_id").alias("r"), F.concat_ws(" ", "source_title", F.array_join("pieces.content", " ")).alias("text"), linkage.title_key(c("source_title")).alias("source_key"))
    # the title in source title and text, or its key in that of the source title
    titles = once.select(c("document_id").alias("l"), "title", linkage.title_key(c("title")).alias("title_key"))
    return linkage.response_match(titles, texts, (("title", "text"), ("title_key", "source_key")))


@query("title_contained_links", "J13", f"""
    WITH a AS (SELECT min(chunk_id) AS l, k FROM (SELECT chunk_id, array_to_string({_subject('section_title')}, ' ') AS k FROM chunks WHERE section_title IS NOT NULL) GROUP BY k), b AS (SELECT document_id AS r, array_to_string({_subject('t')}, ' ') AS k FROM (SELECT document_id, max(title) AS t FROM document_metadata GROUP BY document_id))
    SELECT DISTINCT l, r FROM a JOIN b ON a.k <> '' AND b.k <> '' AND (contains(a.k, b.k) OR contains(b.k, a.k))""")
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title")).withColumn("key", linkage.title_key(c("title")))
    headings = chunks(s, d).where("section_title is not null").groupBy(linkage.title_key(c("section_title")).alias("key")).agg(F.min("chunk_id").alias("chunk_id"))
    return linkage.contained_join(headings, once, "chunk_id", "document_id", "key", "key")


@query("unique_title_links", "R3", f"""
    WITH t AS (SELECT DISTINCT document_id, document_role, {_fold('title')} AS f FROM document_metadata WHERE title IS NOT NULL), q AS (SELECT *, list_last(regexp_extract_all(f, '[«"]\\s*([^»"]{{8,}}?)\\s*[»"]', 1)) AS q FROM t),
    k AS (SELECT document_id, document_role, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(CASE WHEN q IS NOT NULL THEN q ELSE regexp_replace(f, '\\.pdf$', '') END, '\\bri\\s*\\d+\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({linkage.EMPTY_WORDS}, w) AND NOT regexp_matches(w, '^20\\d\\d$')), ' ') AS k FROM q),
    u AS (SELECT k, min(document_id) AS r FROM (SELECT DISTINCT document_id, k FROM k WHERE document_role <> 'municipal_response' AND k <> '') GROUP BY k HAVING count(*) = 1)
    SELECT DISTINCT document_id AS l, r FROM k JOIN u USING (k) WHERE document_role = 'municipal_response' AND document_id <> r""")
def _(s, d):
    rows = docs(s, d).select("document_id", "title", "document_role").distinct()
    return linkage.unique_title_links(rows.where("document_role = 'municipal_response'"), rows.where("document_role <> 'municipal_response'"))


@query("fuzzy_title_links", "R1 R2 W4 J10 Z28", None)
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title"), F.max("document_role").alias("document_role"), F.max("listing_year").alias("listing_year"), F.max(F.get("authors", F.lit(0))["name"]).alias("author"))
    return linkage.link_by_title(once.where("document_role = 'municipal_response'"), once.where("document_role = 'interpellation_text'"), author="author", year="listing_year")


@query("audited_links", "Z51", """
    SELECT coalesce(f.k, o.k) AS k, coalesce(o.v, f.v) AS v, CASE WHEN o.k IS NOT NULL THEN 'audited_override' ELSE 'matched' END AS origin
    FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) f FULL JOIN (SELECT s_suppkey * 2 AS k, s_nationkey AS v FROM supplier) o ON f.k = o.k""")
def _(s, d):
    found = table(s, d, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").alias("v"))
    given = table(s, d, "supplier").select((c("s_suppkey") * 2).alias("k"), c("s_nationkey").alias("v"))
    return linkage.with_override(found, given, "k", "v")


def consecutive(s: SparkSession, d: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each snapshot of the inventory but the last as the one before, and each but the first as the one after; both bear the later number, and ``k`` with the URL."""
    once = table(s, d, "site_inventory").groupBy("snapshot_no", "pdf_url").agg(*[F.max(x).alias(x) for x in columns])
    numbers = table(s, d, "site_inventory").select("snapshot_no").distinct()
    old = once.withColumn("snapshot_no", c("snapshot_no") + 1).join(F.broadcast(numbers), "snapshot_no", "left_semi")
    new = once.join(F.broadcast(numbers.select((c("snapshot_no") + 1).alias("snapshot_no"))), "snapshot_no", "left_semi")
    keyed = lambda df: df.withColumn("k", F.concat_ws(" ", "snapshot_no", "pdf_url"))
    return keyed(old), keyed(new)


#: The same in SQL: ``o`` and ``n`` with the later number ``s``.
_CONSECUTIVE = """x AS (SELECT snapshot_no AS s, pdf_url, max(title) AS title, max(category) AS category, max(content_length) AS l, max(last_modified) AS m, max(etag) AS e FROM site_inventory GROUP BY ALL),
    o AS (SELECT * REPLACE (s + 1 AS s) FROM x WHERE s + 1 IN (SELECT s FROM x)), n AS (SELECT * FROM x WHERE s - 1 IN (SELECT s FROM x))"""


@query("set_difference", "U1", "WITH " + _CONSECUTIVE + """
    SELECT coalesce(o.s, n.s) AS snapshot_no, count(*) FILTER (WHERE o.s IS NOT NULL AND n.s IS NOT NULL) AS common, count(*) FILTER (WHERE n.s IS NULL) AS only_old, count(*) FILTER (WHERE o.s IS NULL) AS only_new, count(*) FILTER (WHERE o.s IS NULL OR n.s IS NULL) = 0 AS equal
    FROM o FULL JOIN n ON o.pdf_url = n.pdf_url AND o.s = n.s GROUP BY 1""")
def _(s, d):
    return linkage.set_difference(*consecutive(s, d, ["title"]), "pdf_url", ["snapshot_no"])


# ---- windows and ranks ----------------------------------------------------------------------------------------


@query("first_chunks", "W1", "SELECT chunk_id, document_id, rn FROM (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id, loaded_at) AS rn FROM chunks) WHERE rn <= 2")
def _(s, d):
    rn = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id", "loaded_at"))
    return chunks(s, d).select("chunk_id", "document_id", rn.alias("rn")).where("rn <= 2")


@query("interleaved", "W3", """
    WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
    SELECT vec_id, label, rn, row_number() OVER (ORDER BY rn, label) AS place FROM (SELECT * FROM r WHERE rn <= 40 ORDER BY rn, label LIMIT 40)""")
def _(s, d):
    return dedup.interleave(table(s, d, "embeddings").select("vec_id", "label"), "label", [c("vec_id")], "vec_id", 40)


@query("best_with_margin", "W4 R2", """
    SELECT k, cand, score, margin, CASE WHEN score >= 0.98 AND margin >= 0.05 THEN 'exact' WHEN score >= 0.76 AND margin >= 0.08 THEN 'probable' ELSE 'manual' END AS tier FROM (
      SELECT k, cand, score, score - coalesce(lead(score) OVER (PARTITION BY k ORDER BY score DESC, cand), 0) AS margin, row_number() OVER (PARTITION BY k ORDER BY score DESC, cand) AS rn
      FROM (SELECT l_orderkey AS k, l_linenumber AS cand, CAST(l_quantity AS DOUBLE) / 50 AS score FROM lineitem)) WHERE rn = 1""")
def _(s, d):
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("cand"), (c("l_quantity").cast("double") / 50).alias("score"))
    return dedup.best_and_margin(rows, "k", "cand", "score").withColumn("tier", dedup.tier(c("score"), c("margin")))


@query("spaced_markers", "W6", None)
def _(s, d):
    texts = table(s, d, "documents").where("text <> ''").select("doc_id", segment.positions(c("text"), "CHF ").alias("starts"))
    starts = c("starts")
    return texts.select("doc_id", F.posexplode(segment.spaced(starts, 120)).alias("marker_no", "position"))


@query("sections_by_marker", "W7 W8", """
    SELECT document_id, chunk_index, lead(chunk_index, 1, 9999) OVER (PARTITION BY document_id ORDER BY chunk_index) AS until, section_title FROM (
      SELECT DISTINCT document_id, chunk_index, section_title FROM chunks WHERE section_title IS NOT NULL)""")
def _(s, d):
    rows = chunks(s, d).where("section_title is not null").select("document_id", "chunk_index", "section_title").distinct()
    return rows.select("document_id", "chunk_index", F.lead("chunk_index", 1, 9999).over(Window.partitionBy("document_id").orderBy("chunk_index")).alias("until"), "section_title")


@query("carried_heading", "S19 W8", """
    SELECT document_id, chunk_index, last_value(section_title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS heading FROM (SELECT document_id, chunk_index, max(section_title) AS section_title FROM chunks GROUP BY ALL)""")
def _(s, d):
    once = chunks(s, d).groupBy("document_id", "chunk_index").agg(F.max("section_title").alias("section_title"))
    return once.select("document_id", "chunk_index", F.last("section_title", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)).alias("heading"))


@query("running_index", "W9", "SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, chunk_index, chunk_id, loaded_at) - 1 AS running FROM chunks")
def _(s, d):
    return chunks(s, d).select("chunk_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("section_index", "chunk_index", "chunk_id", "loaded_at")) - 1).alias("running"))


# ---- texts ----------------------------------------------------------------------------------------------------


@query("normalized_titles", "T1 T2 T5 T6", f"""
    SELECT DISTINCT title, trim(regexp_replace({_fold('title')}, '[^a-z0-9]+', ' ', 'g')) AS words, left(regexp_replace(regexp_replace({_fold('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug
    FROM document_metadata WHERE title IS NOT NULL""")
def _(s, d):
    return docs(s, d).where("title is not null").select("title", text.normalized_words(c("title")).alias("words"), text.slug(c("title"), 60).alias("slug")).distinct()


@query("reread_titles", "T3", None)
def _(s, d):
    return docs(s, d).where(text.badness(c("title")) > 0).select("document_id", "title", text.reread(c("title")).alias("reread")).distinct()


@query("clean_contents", "T4 T7", None)
def _(s, d):
    return chunks(s, d).select("chunk_id", text.without_page_lines(text.clean_text(c("content"))).alias("content")).distinct()


@query("word_counts", "T8", f"SELECT chunk_id, len({_words('content')}) AS words FROM chunks")
def _(s, d):
    return chunks(s, d).select("chunk_id", text.word_count(c("content")).cast("long").alias("words"))


@query("quoted_titles", "T10 Z27", "SELECT DISTINCT document_id, trim(regexp_extract(title, '«\\s*([^»]{3,200})\\s*»', 1)) AS phrase FROM document_metadata WHERE length(trim(regexp_extract(title, '«\\s*([^»]{3,200})\\s*»', 1))) >= 6 AND contains(trim(regexp_extract(title, '«\\s*([^»]{3,200})\\s*»', 1)), ' ')")
def _(s, d):
    return docs(s, d).select("document_id", F.explode(text.quoted_phrases(c("title"))).alias("phrase")).distinct()


@query("capitalized_words", "T11", f"""
    SELECT item_id, array_to_string(list_filter(w[2:], lambda x: length(x) >= 4 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT list_contains({sorted(text.COMMON_CAPITALIZED)}, {_fold('x')})), ',') AS keywords FROM (SELECT item_id, regexp_extract_all(question, '\\p{{L}}[\\p{{L}}\\p{{N}}_''-]*') AS w FROM eval_items)""")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", F.array_join(text.capitalized_keywords(c("question")), ",").alias("keywords"))


@query("stripped_markup", "T12 T13", "SELECT doc_id, length(regexp_replace('<p class=\"x\"><b>' || source || '</b> ' || coalesce(category, '-') || '</p>', '<[^>]+>', '', 'g')) AS chars, source || ' ' || coalesce(category, '-') AS plain FROM documents")
def _(s, d):
    page = F.concat(F.lit('<p class="x"><b>'), c("source"), F.lit("</b> "), F.coalesce("category", F.lit("-")), F.lit("</p>"))
    return table(s, d, "documents").select("doc_id", F.length(F.regexp_replace(page, "<[^>]+>", "")).cast("long").alias("chars"), text.strip_tags(page).alias("plain"))


@query("listing_links", "S13", "SELECT snapshot_no, commune_key, min(title) AS first_title, count(*) AS links FROM (SELECT DISTINCT snapshot_no, commune_key, pdf_url, title FROM site_inventory WHERE title IS NOT NULL) GROUP BY ALL")
def _(s, d):
    rows = table(s, d, "site_inventory").where("title is not null").select("snapshot_no", "commune_key", "pdf_url", "title").distinct()
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = rows.select("snapshot_no", "commune_key", F.concat(F.lit('<li><a class="x" href="'), "pdf_url", F.lit('">'), escaped, F.lit("</a></li>")).alias("html"), "title")
    found = page.select("snapshot_no", "commune_key", "title", F.explode(html.links(c("html"))).alias("l"))
    return found.groupBy("snapshot_no", "commune_key").agg(F.min("title").alias("first_title"), F.count("*").alias("links"))


@query("url_parts", "T13 Z46", "SELECT DISTINCT pdf_url, regexp_extract(pdf_url, '([^/]*)$', 1) AS file, nullif(regexp_extract(pdf_url, '/(20\\d{2})/', 1), '') AS year, regexp_extract(pdf_url, '^https?://([^/]+)', 1) AS host FROM site_inventory")
def _(s, d):
    return table(s, d, "site_inventory").select("pdf_url", text.basename(c("pdf_url")).alias("file"), dates.url_year(c("pdf_url")).alias("year"), F.try_parse_url("pdf_url", F.lit("HOST")).alias("host")).distinct()


@query("object_types", "T23 Z16-Z18", f"""
    SELECT DISTINCT source_title, CASE WHEN contains({_fold('source_title')}, 'interpellation') THEN 'interpellation' WHEN contains({_fold('source_title')}, 'postulat') THEN 'postulat' WHEN contains({_fold('source_title')}, 'motion') THEN 'motion' END AS object_type FROM document_metadata WHERE source_title IS NOT NULL""")
def _(s, d):
    return docs(s, d).where("source_title is not null").select("source_title", text.object_type(c("source_title")).alias("object_type")).distinct()


_FACETS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}' END" for n, ws in sorted(text.TOPICS.items()))


@query("topic_facets", "T26", f"SELECT facet, count(*) AS n FROM (SELECT unnest(list_filter([{_FACETS}], lambda x: x IS NOT NULL)) AS facet FROM (SELECT {_fold('title')} AS t FROM document_metadata WHERE title IS NOT NULL)) GROUP BY facet")
def _(s, d):
    return docs(s, d).where("title is not null").select(F.explode(text.facets(c("title"), text.TOPICS)).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@query("first_truthy", "F21", "SELECT DISTINCT document_id, coalesce(nullif(file_url, ''), nullif(source_page_url, ''), '') AS url, coalesce(nullif(title, ''), nullif(source_title, ''), document_id) AS title FROM document_metadata")
def _(s, d):
    return docs(s, d).select("document_id", F.coalesce(text.first_truthy(c("file_url"), c("source_page_url")), F.lit("")).alias("url"), F.coalesce(text.first_truthy(c("title"), c("source_title")), c("document_id")).alias("title")).distinct()


# ---- dates, amounts, hashes ------------------------------------------------------------------------------------

_LONG = "\\b(\\d{1,2})(?:er)?\\s+(janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)\\s+((?:19|20)\\d{2})\\b"
_MONTH = "CASE {0} " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate("janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split(), 1)) + " END"


@query("long_dates", "D1", f"""
    SELECT doc_id, strftime(try_strptime(concat(regexp_extract(t, '{_LONG}', 3), '-', {_MONTH.format(f"regexp_extract(t, '{_LONG}', 2)")}, '-', lpad(regexp_extract(t, '{_LONG}', 1), 2, '0')), '%Y-%m-%d'), '%Y-%m-%d') AS day
    FROM (SELECT doc_id, {_fold('text')} AS t FROM documents) WHERE regexp_matches(t, '{_LONG}')""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", dates.long_date(c("text")).alias("day"), c("text")).where(text.fold(c("text")).rlike(dates.LONG_DATE)).select("doc_id", "day")


@query("written_dates", "D12", f"""
    SELECT DISTINCT document_date, concat(CASE WHEN substr(document_date, 9, 2) = '01' THEN '1er' ELSE CAST(CAST(substr(document_date, 9, 2) AS INTEGER) AS VARCHAR) END, ' ',
      CASE substr(document_date, 6, 2) {' '.join(f"WHEN '{i:02d}' THEN '{m}'" for i, m in enumerate(dates.MONTHS, 1))} END, ' ', left(document_date, 4)) AS written FROM document_metadata WHERE regexp_matches(document_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')""")
def _(s, d):
    return docs(s, d).where(c("document_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("document_date", dates.french_date(c("document_date")).alias("written")).distinct()


@query("year_cascade", "D6 F11", """
    SELECT DISTINCT document_id, coalesce(nullif(CAST(listing_year AS VARCHAR), ''), nullif(left(document_date, 4), '')) AS year, nullif(regexp_extract(file_url, '/(20\\d{2})/', 1), '') AS url_year FROM document_metadata""")
def _(s, d):
    return docs(s, d).select("document_id", dates.derived_year(c("listing_year"), c("legislature"), c("document_date")).alias("year"), dates.url_year(c("file_url")).alias("url_year")).distinct()


@query("year_audit", "D11 A17", """
    SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([
      CASE WHEN y < CAST(nullif(regexp_extract(legislature, '^(\\d{4})-(\\d{4})$', 1), '') AS INTEGER) OR y > CAST(nullif(regexp_extract(legislature, '^(\\d{4})-(\\d{4})$', 2), '') AS INTEGER) THEN 'date_outside_legislature' END,
      CASE WHEN listing_year <> y THEN 'listing_year_differs_from_date' END, CASE WHEN listing_year <> CAST(nullif(regexp_extract(file_url, '/(20\\d{2})/', 1), '') AS INTEGER) THEN 'listing_year_differs_from_url' END,
      CASE WHEN document_date IS NULL THEN 'missing_date' END, CASE WHEN listing_year IS NULL THEN 'missing_listing_year' END], lambda x: x IS NOT NULL)) AS issue
      FROM (SELECT *, CAST(left(document_date, 4) AS INTEGER) AS y FROM document_metadata)) GROUP BY issue""")
def _(s, d):
    rows = docs(s, d).select(dates.year_issues(c("listing_year"), c("document_date"), c("file_url"), c("legislature")).alias("issues"))
    return quality.histogram(rows, "issues")


@query("amounts", "D15-D17", """
    SELECT doc_id, len(a) AS n, round(list_sum(a), 2) AS total, list_max(a) AS largest FROM (
      SELECT doc_id, list_transform(regexp_extract_all(text, 'CHF\\s*(\\d[\\d''’]*(?:[.,]\\d{1,2})?)', 1), lambda x: CAST(replace(replace(replace(x, '''', ''), '’', ''), ',', '.') AS DOUBLE)) AS a FROM documents) WHERE len(a) > 0""")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", dates.amounts(c("text")).alias("a")).where(F.size("a") > 0)
    return rows.select("doc_id", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda x, y: x + y), 2).alias("total"), F.array_max("a").alias("largest"))


@query("content_hashes", "D18-D20", """
    SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s\\x{A0}\\x{202F}\\x{2007}]+', ' ', 'g'))) AS content_hash, sha256(text) AS raw_hash, 'doc_' || left(sha256(text), 20) AS content_id FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", dates.content_hash(c("text")).alias("content_hash"), dates.raw_hash(c("text")).alias("raw_hash"), dates.content_id(c("text")).alias("content_id"))


@query("fingerprints", "D21 T31", """
    WITH k AS (SELECT rpad(hex('public test key'), 128, '0') AS h), b AS (SELECT list_transform(range(1, 129, 2), lambda i: ('0x' || substr(h, i, 2))::INT) AS bytes FROM k),
    p AS (SELECT list_transform(bytes, lambda x: printf('%02x', xor(x, 54))) AS i, list_transform(bytes, lambda x: printf('%02x', xor(x, 92))) AS o FROM b)
    SELECT commune_key, sha256(unhex(array_to_string(o, '') || sha256(unhex(array_to_string(i, '') || hex(source_domain))))) AS fingerprint, regexp_matches('greffe@' || source_domain, '^[^\\s@]+@[^\\s@]+\\.[^\\s@.]{2,}$') AS valid FROM municipalities, p""")
def _(s, d):
    return table(s, d, "municipalities").select("commune_key", dates.hmac_sha256(c("source_domain"), "public test key").alias("fingerprint"), text.valid_email(F.concat(F.lit("greffe@"), "source_domain")).alias("valid"))


@query("ocr_need", "D24", "SELECT document_id, sum(length(content)) AS chars, count(DISTINCT chunk_index) AS pages, sum(length(content)) < greatest(200, 50 * count(DISTINCT chunk_index)) AS needs_ocr FROM chunks GROUP BY document_id")
def _(s, d):
    grouped = chunks(s, d).groupBy("document_id").agg(F.sum(F.length("content")).alias("chars"), F.count_distinct("chunk_index").alias("pages"))
    return grouped.withColumn("needs_ocr", dates.needs_ocr(c("chars"), c("pages")))


# ---- segmentation ----------------------------------------------------------------------------------------------


@query("chunk_windows", "G1 G3 G16 W9", f"""
    WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {_words('text')} AS ws FROM documents), k AS (
      SELECT document_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 120 THEN 1 ELSE CAST(ceil((len(ws) - 20) / 100.0) AS INTEGER) END)) AS i FROM w)
    SELECT document_id, document_id || '#chunk-' || lpad(CAST(i AS VARCHAR), 3, '0') AS chunk_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(ws[i * 100 + 1 : i * 100 + 120], ' ') AS content, len(ws[i * 100 + 1 : i * 100 + 120]) AS word_count FROM k""")
def _(s, d):
    return segment.chunked(table(s, d, "documents"), "doc_id", "text", 120, 20).withColumn("word_count", c("word_count").cast("long"))


@query("source_windows", "G2", """
    WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*') AS w FROM documents),
    n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 120 THEN 1 ELSE ceil((len(w) - 20) / 100.0)::INT END AS n FROM p)
    SELECT doc_id, k::INT AS window_no, regexp_replace(array_to_string(w[k * 100 + 1 : k * 100 + 120], ''), '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g') AS content FROM n, unnest(range(0, n)) AS u(k)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(segment.source_windows(c("text"), 120, 20)).alias("window_no", "content"))


@query("response_sections", "G4 G5", None)
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("document_role").alias("document_role"))
    rows = chunks(s, d).join(once, "document_id").select("chunk_id", F.posexplode(segment.response_sections(c("content"), c("document_role"))).alias("section_no", "x"))
    return rows.select("chunk_id", "section_no", "x.component", "x.section_title", "x.response_number", F.length("x.content").alias("chars")).distinct()


@query("representative_chunks", "G17", """
    WITH o AS (SELECT document_id, chunk_id, chunk_index, min(component) AS component, min(content) AS content FROM chunks GROUP BY ALL), r AS (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS h, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index DESC, chunk_id DESC) AS t FROM o), g AS (
      SELECT *, CASE WHEN h <= 2 THEN 0 WHEN component IN ('report') THEN 1 WHEN t <= 2 THEN 2 END AS priority FROM r)
    SELECT document_id, chunk_id, chunk_index, component, priority, CAST(so_far AS BIGINT) AS so_far FROM (
      SELECT *, sum(length(content)) OVER (PARTITION BY document_id ORDER BY priority, chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) AS so_far FROM g WHERE priority IS NOT NULL) WHERE so_far <= 6000""")
def _(s, d):
    once = chunks(s, d).groupBy("document_id", "chunk_id", "chunk_index").agg(F.min("component").alias("component"), F.min("content").alias("content"))
    return segment.representative(once, ["report"], 2, 6000)


# ---- quality ---------------------------------------------------------------------------------------------------


@query("chunk_quality", "Q9 Q5", f"""
    SELECT chunk_id, words, array_to_string(list_filter([CASE WHEN words > 450 THEN 'chunk_too_long' END, CASE WHEN words < 60 AND NOT is_last THEN 'chunk_too_short' END, CASE WHEN component = 'unknown_component' THEN 'component_not_detected' END,
      CASE WHEN coalesce(section_title, '') = '' THEN 'section_title_missing' END], lambda x: x IS NOT NULL), ',') AS issues,
      CASE WHEN words > 450 THEN 'red' WHEN (words < 60 AND NOT is_last) OR component = 'unknown_component' OR coalesce(section_title, '') = '' THEN 'yellow' ELSE 'green' END AS quality
    FROM (SELECT *, len({_words('content')}) AS words, chunk_index = max(chunk_index) OVER (PARTITION BY document_id) AS is_last FROM chunks)""")
def _(s, d):
    return quality.chunk_quality(chunks(s, d)).withColumn("words", c("words").cast("long"))


@query("input_issues", "Q5 A12", f"""
    WITH w AS (SELECT *, len({_words("coalesce(content, '')")}) AS n, trim(coalesce(content, '')) AS x FROM chunks), i AS (SELECT list_distinct(list_filter([CASE WHEN coalesce(section_title, '') = '' THEN 'missing:section_title' END, CASE WHEN coalesce(content, '') = '' THEN 'missing:content' END, CASE WHEN n > 500 THEN 'content_over_500_words' END, CASE WHEN n BETWEEN 1 AND 9 THEN 'content_under_10_words' END,
      CASE WHEN regexp_matches(x, '\\b\\d{{1,3}}\\s*\\|\\s*\\d{{1,3}}\\b') THEN 'inline_page_marker' END, CASE WHEN length(x) > 24000 THEN 'input_over_24000_characters' END, CASE WHEN regexp_matches(x, '(?i)^(?:page\\s*)?\\d{{1,3}}$') THEN 'standalone_page_number' END], lambda v: v IS NOT NULL) || list_transform(coalesce(quality_issues, []), lambda v: 'upstream:' || v)) AS a FROM w)
    SELECT issue, count(*) AS n FROM (SELECT unnest(a) AS issue FROM i) GROUP BY issue""")
def _(s, d):
    return quality.histogram(quality.input_issues(chunks(s, d), ["chunk_id", "document_id", "content", "section_title"]), "issues")


@query("tagged_duplicates", "Q6", "SELECT doc_id, (count(*) OVER (PARTITION BY sha256(text))) > 1 AS is_duplicate FROM documents")
def _(s, d):
    return quality.tagged_duplicates(table(s, d, "documents").select("doc_id", "text"), F.sha2("text", 256)).select("doc_id", "is_duplicate")


@query("duplicate_groups", "Q7 A13 Z53", "SELECT sha256(text) AS key, count(*) AS members, count(*) - 1 AS surplus, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return quality.duplicate_groups(table(s, d, "documents"), F.sha2("text", 256), "doc_id")


@query("documents_without_chunks", "Q8 S30", """
    SELECT DISTINCT document_id, CASE WHEN extraction_method IN ('ocr_required', 'native_pdf_pending_ocr') THEN 'ocr_pending' WHEN extraction_method IS NULL THEN 'extraction_unknown' ELSE 'no_text' END AS reason FROM document_metadata ANTI JOIN chunks USING (document_id)""")
def _(s, d):
    return quality.documents_without_chunks(docs(s, d), chunks(s, d))


_REQ = ["document_id", "commune", "category", "document_role", "title", "file_url", "document_date", "content_hash"]
_MISS = ", ".join(f"CASE WHEN coalesce(CAST({x} AS VARCHAR), '') = '' THEN 'missing_{x}' END" for x in _REQ)


@query("preindex_audit", "Q10-Q12", f"""
    WITH j AS (SELECT m.*, coalesce(t.chars, 0) AS chars, coalesce(extraction_method IN ('ocr_required', 'native_pdf_pending_ocr'), false) AS pending FROM document_metadata m LEFT JOIN (SELECT document_id, sum(length(content)) AS chars FROM chunks GROUP BY document_id) t USING (document_id)),
    b AS (SELECT document_id, array_to_string(list_filter([{_MISS}, CASE WHEN pending THEN 'ocr_required' END], lambda x: x IS NOT NULL), ',') AS blockers, CASE WHEN chars < 500 AND NOT pending THEN 'very_short_text' ELSE '' END AS warnings FROM j)
    SELECT *, CASE WHEN blockers <> '' THEN 'blocked' WHEN warnings <> '' THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM b""")
def _(s, d):
    chars = chunks(s, d).groupBy("document_id").agg(F.sum(F.length("content")).alias("chars"))
    return quality.preindex_audit(docs(s, d), chars, _REQ)


@query("record_comparison", "J19 Q18", "WITH " + _CONSECUTIVE + """,
    j AS (SELECT coalesce(o.s, n.s) || ' ' || coalesce(o.pdf_url, n.pdf_url) AS k, o.title AS ot, n.title AS nt, o.category AS oc, n.category AS nc FROM o FULL JOIN n ON o.pdf_url = n.pdf_url AND o.s = n.s)
    SELECT k, 'title' AS field, CASE WHEN ot IS NULL AND nt IS NULL THEN 'both_missing' WHEN nt IS NULL THEN 'only_old' WHEN ot IS NULL THEN 'only_new' WHEN ot = nt THEN 'identical' ELSE 'different' END AS status FROM j
    UNION ALL SELECT k, 'category', CASE WHEN oc IS NULL AND nc IS NULL THEN 'both_missing' WHEN nc IS NULL THEN 'only_old' WHEN oc IS NULL THEN 'only_new' WHEN oc = nc THEN 'identical' ELSE 'different' END FROM j""")
def _(s, d):
    return quality.compare_records(*consecutive(s, d, ["title", "category"]), "k", ["title", "category"])


@query("expectation_diff", "Q15", "SELECT 'eval_items' AS name, 250 AS expected, count(*) AS actual FROM eval_items WHERE (SELECT count(*) FROM eval_items) <> 250")
def _(s, d):
    n = lambda t: table(s, d, t).agg(F.count("*").alias("value")).select(F.lit(t).alias("name"), "value")
    actual = n("municipalities").unionByName(n("eval_items"))
    expected = s.createDataFrame([("municipalities", 24), ("eval_items", 250)], "name string, value long")
    return quality.expectations(actual, expected)


@query("margin_lines", "Q2", """
    WITH l AS (SELECT document_id, chunk_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos, len(string_split(content, chr(10))) AS n FROM (SELECT DISTINCT document_id, chunk_id, content FROM chunks)),
    m AS (SELECT DISTINCT document_id, chunk_id, trim(regexp_replace(line, '[\\s\\x{A0}\\x{202F}\\x{2007}]+', ' ', 'g')) AS line FROM l WHERE pos < 5 OR pos >= n - 5), h AS (SELECT document_id, line, count(*) AS hits FROM m WHERE line <> '' GROUP BY ALL)
    SELECT h.document_id, line, hits, pages FROM h JOIN (SELECT document_id, count(DISTINCT chunk_id) AS pages FROM chunks GROUP BY document_id) p USING (document_id) WHERE hits >= greatest(3, round_even(pages * 0.35, 0))""")
def _(s, d):
    return quality.repeated_margin_lines(chunks(s, d), "chunk_id", "document_id", "content")


# ---- deduplication ---------------------------------------------------------------------------------------------


@query("first_occurrence", "R5 R10 R12", "SELECT sha256(text) AS key, arg_min(doc_id, (fetched_at, doc_id)) AS kept, count(DISTINCT doc_id) AS occurrences, arg_max(doc_id, (fetched_at, doc_id)) AS last FROM documents GROUP BY 1")
def _(s, d):
    return dedup.keep_with_occurrences(table(s, d, "documents"), F.sha2("text", 256), "doc_id", c("fetched_at"))


@query("dropped_copies", "R6-R8", """
    WITH k AS (SELECT doc_id, sha256(text) AS key, CASE WHEN source = 'archives_seances' THEN 1 ELSE 0 END AS rank FROM documents), b AS (SELECT key, arg_min(doc_id, (rank, doc_id)) AS kept, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1)
    SELECT doc_id AS dropped, kept FROM k JOIN b USING (key) WHERE doc_id <> kept""")
def _(s, d):
    return dedup.dropped_by_content(table(s, d, "documents"), F.sha2("text", 256), "doc_id", (c("source") == "archives_seances").cast("int"))


@query("title_aliases", "R9", f"""
    WITH k AS (SELECT DISTINCT document_id AS id, trim(regexp_replace({_fold('title')}, '[^a-z0-9]+', ' ', 'g')) AS key FROM document_metadata WHERE title IS NOT NULL), g AS (SELECT key, min(id) AS main, count(*) - 1 AS others FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1)
    SELECT DISTINCT id, main, others FROM k JOIN g USING (key)""")
def _(s, d):
    return dedup.aliases(docs(s, d), text.normalized_words(c("title")), "document_id")


@query("latest_delivery", "U4 R6", "SELECT document_id, arg_max(processing_status, loaded_at) AS processing_status, max(epoch(loaded_at))::BIGINT AS loaded FROM document_metadata WHERE processing_status IS NOT NULL GROUP BY document_id")
def _(s, d):
    rows = docs(s, d).where("processing_status is not null")
    return rows.groupBy("document_id").agg(F.max_by("processing_status", "loaded_at").alias("processing_status"), F.max(F.unix_seconds("loaded_at")).alias("loaded"))


# ---- retrieval -------------------------------------------------------------------------------------------------


def _query_vector(s: SparkSession, d: str) -> list[float]:
    row = table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    # without the row nothing is near
    return row[0] if row and row[0] else [0.0]


@query("vector_topk", "V1 O3 V16 W2", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 10")
def _(s, d):
    return retrieval.vector_search(table(s, d, "embeddings"), _query_vector(s, d), 10, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_filtered", "V1", "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 10")
def _(s, d):
    return retrieval.vector_search(table(s, d, "embeddings"), _query_vector(s, d), 10, c("label") == 3, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_topk_per_group", "V8", "SELECT vec_id, label, rn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS score FROM embeddings)) WHERE rn <= 3")
def _(s, d):
    return retrieval.vector_search_per_group(table(s, d, "embeddings"), _query_vector(s, d), 3, "label", "vec_id").select("vec_id", "label", "rn", F.round("score", 6).alias("score"))


@query("title_search", "V2", "SELECT c.chunk_id, c.document_id, 1.0::DOUBLE AS score FROM (SELECT DISTINCT chunk_id, document_id, chunk_index FROM chunks) c JOIN (SELECT DISTINCT document_id FROM document_metadata WHERE title ILIKE '%patrimoine bâti%') m USING (document_id) ORDER BY c.document_id, c.chunk_index, c.chunk_id LIMIT 15")
def _(s, d):
    once = chunks(s, d).select("chunk_id", "document_id", "chunk_index").distinct()
    titles = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title"), F.max("category").alias("category"))
    return retrieval.title_search(once, titles, "patrimoine bâti").select("chunk_id", "document_id", "score")


@query("keyword_search", "V3", """
    WITH c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, content FROM chunks), m AS (SELECT document_id, max(title) AS title, max(category) AS category FROM document_metadata GROUP BY document_id)
    SELECT chunk_id, document_id, 0.9::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS rn FROM c JOIN m USING (document_id) WHERE category = 'motion' AND (coalesce(title ILIKE '%Sergnole%', false) OR coalesce(content ILIKE '%Sergnole%', false)))
    WHERE rn <= 2 ORDER BY document_id, chunk_index, chunk_id LIMIT 40""")
def _(s, d):
    titles = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title"), F.max("category").alias("category"))
    return retrieval.keyword_search(chunks(s, d), titles, "Sergnole", where=c("category") == "motion").select("chunk_id", "document_id", "score")


def _search(s: SparkSession, d: str) -> DataFrame:
    rows = chunks(s, d)
    ids = rows.select("chunk_id", "document_id", "chunk_index").distinct()
    titles = docs(s, d).groupBy("document_id").agg(F.max("title").alias("title"), F.max("category").alias("category"))
    near = retrieval.vector_search_once(rows, [1.0] * 64, 20, ["chunk_id", "document_id"])
    return retrieval.fuse(retrieval.title_search(ids, titles, "patrimoine bâti"), retrieval.keyword_search(rows, titles, "Sergnole"), near, 20)


_FUSED = """
    WITH c AS (SELECT chunk_id, document_id, chunk_index, max(content) AS content, max(embedding) AS e FROM chunks GROUP BY ALL), m AS (SELECT document_id, max(title) AS title FROM document_metadata GROUP BY document_id),
    t AS (SELECT chunk_id, document_id, 1.0 AS score, 0 AS stage FROM c JOIN m USING (document_id) WHERE title ILIKE '%patrimoine bâti%' ORDER BY document_id, chunk_index, chunk_id LIMIT 15),
    kw AS (SELECT chunk_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS rn FROM c JOIN m USING (document_id) WHERE coalesce(title ILIKE '%Sergnole%', false) OR coalesce(content ILIKE '%Sergnole%', false)) WHERE rn <= 2 ORDER BY document_id, chunk_index, chunk_id LIMIT 40),
    k AS (SELECT min(chunk_id) AS chunk_id, document_id, 0.9 AS score, 1 AS stage FROM kw WHERE document_id NOT IN (SELECT document_id FROM t) GROUP BY document_id ORDER BY document_id LIMIT 10),
    v AS (SELECT chunk_id, document_id, score, 2 AS stage FROM (SELECT *, list_cosine_similarity(e::DOUBLE[], list_transform(range(64), lambda i: 1.0::DOUBLE)) AS score FROM c WHERE e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: abs(x)), 'sum') > 0) ORDER BY score DESC, chunk_id LIMIT 20),
    f AS (SELECT *, row_number() OVER (ORDER BY stage, score DESC, document_id, chunk_id) AS place FROM (SELECT chunk_id, any_value(document_id) AS document_id, arg_min(score, (stage, -score)) AS score, min(stage) AS stage FROM (SELECT * FROM t UNION ALL SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY chunk_id) QUALIFY place <= 20)"""


@query("hybrid_search", "V4", _FUSED + " SELECT place, chunk_id, document_id, stage, round(score, 6) AS score FROM f")
def _(s, d):
    return _search(s, d).select("place", "chunk_id", "document_id", "stage", F.round("score", 6).alias("score"))


@query("expanded_search", "V6 V5 A9 A10", _FUSED + """, b AS (SELECT document_id, max(score) AS s FROM f GROUP BY document_id ORDER BY s DESC, document_id LIMIT 3), n AS (SELECT DISTINCT chunk_id, document_id FROM chunks),
    x AS (SELECT chunk_id, document_id, s FROM n JOIN b USING (document_id) WHERE (SELECT count(*) FROM n y WHERE y.document_id = n.document_id) <= 15 UNION ALL SELECT chunk_id, document_id, score FROM f)
    SELECT document_id, round(max(s), 6) AS top_score, count(DISTINCT chunk_id) AS passages FROM x GROUP BY document_id""")
def _(s, d):
    once = chunks(s, d).select("chunk_id", "document_id").distinct()
    return retrieval.group_by_document(retrieval.expand_small_documents(_search(s, d), once)).select("document_id", F.round("top_score", 6).alias("top_score"), "passages")


@query("reranked_search", "V10", _FUSED + " SELECT chunk_id, document_id FROM f ORDER BY CASE WHEN place > (SELECT max(place) FROM f) - 3 THEN -place ELSE 1000 + place END LIMIT 15")
def _(s, d):
    found = _search(s, d)
    last = [r[0] for r in found.orderBy(F.desc("place")).limit(3).collect()]
    return retrieval.rerank_filled(found, last, 15).select("chunk_id", "document_id")


# ---- loading ---------------------------------------------------------------------------------------------------


@query("upserted", "K1-K3", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) || '*', c_nationkey FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    old = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = old.where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("*")))
    return store.upsert(old, new, ["c_custkey"])


@query("upserted_coalesced", "K9", """
    SELECT pdf_url, arg_max(title, s) FILTER (WHERE title IS NOT NULL) AS title, arg_max(etag, s) FILTER (WHERE etag IS NOT NULL) AS etag, min(s) AS first_seen
    FROM (SELECT pdf_url, snapshot_no AS s, max(title) AS title, max(etag) AS etag FROM site_inventory GROUP BY ALL) GROUP BY pdf_url""")
def _(s, d):
    at = lambda n: table(s, d, "site_inventory").where(c("snapshot_no") == n).groupBy("pdf_url").agg(F.max("title").alias("title"), F.max("etag").alias("etag"), F.min("snapshot_no").alias("first_seen"))
    state = at(1)
    for n in range(2, 7):
        state = store.upsert_coalesced(state, at(n), "pdf_url", ["first_seen"])
    return state


@query("stale_children", "K4 K19", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber > 2 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2))")
def _(s, d):
    old = table(s, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("child", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    new = old.where("l_orderkey % 5 = 0 and l_linenumber <= 2")
    return store.without_stale_children(old, new, "l_orderkey", "child").select("l_orderkey", "l_linenumber")


@query("scope_guard", "K5", "SELECT count(*) AS before, count(*) AS after, true AS safe FROM customer WHERE c_nationkey <> 7")
def _(s, d):
    rows = table(s, d, "customer")
    return store.unrelated_counts(rows, rows.where("c_nationkey <> 7 or c_custkey % 2 = 0"), c("c_nationkey") == 7)


@query("backfilled", "K13", "SELECT chunk_id, CASE WHEN trim(coalesce(section_title, '')) = '' THEN left(content, 40) ELSE section_title END AS section_title FROM chunks")
def _(s, d):
    return store.backfilled(chunks(s, d), "section_title", F.left("content", F.lit(40))).select("chunk_id", "section_title")


@query("inventory_log", "J20 I1", "WITH " + _CONSECUTIVE + """
    SELECT n.s || ' ' || n.pdf_url AS k, 'new' AS change_type FROM n ANTI JOIN o USING (pdf_url, s) UNION ALL SELECT n.s || ' ' || n.pdf_url, 'renamed' FROM n JOIN o USING (pdf_url, s) WHERE n.title IS DISTINCT FROM o.title
    UNION ALL SELECT n.s || ' ' || n.pdf_url, 'content_changed' FROM n JOIN o USING (pdf_url, s) WHERE n.l IS NOT NULL AND (n.l IS DISTINCT FROM o.l OR n.m IS DISTINCT FROM o.m OR n.e IS DISTINCT FROM o.e)""")
def _(s, d):
    old, new = (df.drop("pdf_url").withColumnRenamed("k", "pdf_url") for df in consecutive(s, d, ["title", "content_length", "last_modified", "etag"]))
    return store.change_log(old, new).withColumnRenamed("pdf_url", "k")


@query("cached_vectors", "J9 I2", """
    WITH o AS (SELECT DISTINCT chunk_id, chunk_hash, sha256(content) AS h, chunk_index FROM chunks) SELECT CASE WHEN chunk_index % 4 <> 1 THEN 'reused' ELSE 'pending' END AS state, count(*) AS n FROM o GROUP BY 1
    UNION ALL SELECT 'stale', count(*) FROM o WHERE chunk_index % 4 = 1""")
def _(s, d):
    inputs = chunks(s, d).select("chunk_id", c("chunk_hash").alias("content_hash"), F.sha2("content", 256).alias("input_hash"), "chunk_index").distinct()
    cache = inputs.withColumn("input_hash", F.when(c("chunk_index") % 4 == 1, "old").otherwise(c("input_hash"))).withColumn("embedding", F.lit(1)).drop("chunk_index")
    parts = zip(("reused", "pending", "stale"), store.cached_vectors(inputs, cache))
    out = None
    for name, rows in parts:
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# ---- questions -------------------------------------------------------------------------------------------------


def _names(s: SparkSession, d: str) -> dict[str, str]:
    rows = table(s, d, "municipalities").where("search_enabled").select("label", "aliases").collect()
    return {n: r[0] for r in rows for n in [r[0], *(r[1] or [])]}


@query("question_counts", "N1-N4 A7", """
    SELECT a.name AS name, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest(authors) AS a FROM document_metadata WHERE commune = 'Châtel-Névis' AND category = 'interpellation') WHERE a.name IS NOT NULL AND a.civility IN ('Mme', 'Madame') GROUP BY a.name""")
def _(s, d):
    spec = question.understand("Combien d’interpellations ont été déposées à Châtel-Névis par des femmes ?", _names(s, d))
    return question.compile_spec(spec, docs(s, d), chunks(s, d))


@query("question_search", "N1-N5 N9 V4", None)
def _(s, d):
    spec = question.understand("Que disent les préavis de Sergnole sur « le patrimoine bâti » ?", _names(s, d))
    return question.compile_spec(spec, docs(s, d), chunks(s, d), [1.0] * 64).select("place", "chunk_id", "document_id", "stage")


# ---- star schema -----------------------------------------------------------------------------------------------


@query("revenue_by_nation", "J1 A4 O1", """
    SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(s, d):
    joined = (
        table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
        .join(table(s, d, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).join(table(s, d, "nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
    )
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(c("l_extendedprice").cast("double") * (1 - c("l_discount").cast("double"))), 2).alias("revenue"))


@query("p4_found", "snapshot differences", """
    WITH r AS (SELECT snapshot_no AS s, pdf_url AS u, regexp_replace(trim(regexp_replace(trim(etag), '^W/', ''), '"'), '-gzip$', '') AS e,
      epoch(CASE WHEN regexp_matches(last_modified, 'GMT$') THEN try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT') WHEN regexp_matches(last_modified, '^[A-Z]') THEN try_strptime(regexp_replace(last_modified, ' +', ' ', 'g'), '%a %b %d %H:%M:%S %Y')
        WHEN regexp_matches(last_modified, '[+-]\\d\\d:\\d\\d$') THEN try_strptime(left(last_modified, 19), '%Y-%m-%dT%H:%M:%S') - to_hours(CAST(substr(last_modified, 20, 3) AS INTEGER)) ELSE try_strptime(left(last_modified, 19), '%Y-%m-%dT%H:%M:%S') END) AS m, last_checked AS t FROM site_inventory),
    o AS (SELECT s, u, arg_max(e, t) FILTER (WHERE e IS NOT NULL) AS e, arg_max(m, t) FILTER (WHERE m IS NOT NULL) AS m FROM r GROUP BY s, u), g AS (SELECT *, s - row_number() OVER (PARTITION BY u ORDER BY s) AS run FROM o),
    k AS (SELECT s, u, run, e, m, last_value(e IGNORE NULLS) OVER w AS ke, last_value(m IGNORE NULLS) OVER w AS km FROM g WINDOW w AS (PARTITION BY u, run ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT s AS snapshot_no, u AS pdf_url, 'changed' AS change_type FROM k WHERE (e <> ke) OR (m <> km)
    UNION ALL SELECT s, u, 'added' FROM k a WHERE s > (SELECT min(s) FROM o) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.u = a.u AND b.s = a.s - 1)
    UNION ALL SELECT s + 1, u, 'removed' FROM k a WHERE s < (SELECT max(s) FROM o) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.u = a.u AND b.s = a.s + 1)""")
def _(s, d):
    return snapshots.inventory_changes(table(s, d, "site_inventory"))
