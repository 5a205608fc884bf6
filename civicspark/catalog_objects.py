"""Queries on political objects: answered and unanswered ones by stored ids, deduplication, links, sessions, records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicspark.catalog import c, chunks, docs, query
from civicspark.catalog_records import cat, council, lit
from civicspark.functions import records, text
from civicspark.operators import objects
from civicspark.sources.tables import table


def once(s, d):
    """One row for each document."""
    return docs(s, d).groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("document_role", "commune_key", "listing_year", "document_date", "title", "category")])


_M = "m AS (SELECT document_id, max(document_role) AS role, max(commune_key) AS ck, max(listing_year) AS y, max(document_date) AS dd, max(title) AS t, max(category) AS ca FROM document_metadata GROUP BY document_id)"
_LINKS = _M + """, o AS (SELECT document_id AS object_id, ck, y, dd FROM m WHERE role = '{0}'),
    l AS (SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY r.document_id) AS pos, r.document_id AS rid FROM o JOIN m r ON r.role = 'municipal_response' AND r.ck = o.ck AND r.y = o.y),
    ns AS (SELECT document_id AS rid, list_sort(list_distinct(list(response_number))) AS nums FROM chunks WHERE response_number IS NOT NULL GROUP BY document_id)"""


def stored(s, d, role):
    """Objects of a role, the ids of responses stored with them (those of their municipality and year), and the responses with their numbers."""
    rows = once(s, d)
    own = rows.where(c("document_role") == role).select(c("document_id").alias("object_id"), "commune_key", "listing_year", c("document_date").alias("political_date"))
    answers = rows.where("document_role = 'municipal_response'")
    found = own.join(answers.select(c("document_id").alias("response_id"), "commune_key", "listing_year"), ["commune_key", "listing_year"]).select("object_id", "response_id")
    links = found.withColumn("position", F.row_number().over(Window.partitionBy("object_id").orderBy("response_id")))
    numbers = chunks(s, d).where("response_number is not null").groupBy(c("document_id").alias("response_id")).agg(F.array_sort(F.collect_set("response_number")).alias("numbers"))
    responses = answers.select(c("document_id").alias("response_id"), c("document_role").alias("role"), lit("").alias("text"), "document_date", "listing_year", lit("").alias("reference")).join(numbers, "response_id", "left")
    return own, links, responses


def own_entries(own):
    """Two entries for every other object: one with a number that no response has, one without."""
    nulls = [lit(None).cast("string").alias("adoption_date"), lit(None).cast("string").alias("entry_date")]
    return own.where("length(object_id) % 2 = 0").select("object_id", F.posexplode(F.array(lit("1/1900"), lit(None).cast("string"))).alias("entry_no", "response_number")).select("*", *nulls)


_ENTRIES = _LINKS + """, e AS (SELECT object_id, 0 AS no, '1/1900' AS num FROM o WHERE length(object_id) % 2 = 0 UNION ALL SELECT object_id, 1, NULL FROM o WHERE length(object_id) % 2 = 0
      UNION ALL SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY pos, i) - 1, nums[i] FROM (SELECT l.object_id, l.pos, ns.nums, unnest(range(1, len(ns.nums) + 1)) AS i FROM l JOIN ns USING (rid) WHERE length(l.object_id) % 2 = 1)),
    x AS (SELECT e.object_id, e.no, e.num, coalesce((SELECT arg_min(l.rid, l.pos) FROM l LEFT JOIN ns USING (rid) WHERE l.object_id = e.object_id AND (e.num IS NULL OR list_contains(ns.nums, e.num))), (SELECT CASE WHEN count(*) = 1 THEN min(l.rid) END FROM l WHERE l.object_id = e.object_id)) AS rid FROM e)"""


@query("response_entries", "J21 Z34", "WITH " + _ENTRIES.format("interpellation_text") + " SELECT object_id, CAST(no AS INTEGER) AS entry_no, num AS response_number, rid AS response_id FROM x")
def _(s, d):
    own, links, responses = stored(s, d, "interpellation_text")
    return objects.matched_entries(own, own_entries(own), links, responses).select("object_id", "entry_no", "response_number", "response_id")


@query("answered_interpellations", "V11 D5 D6", "WITH " + _ENTRIES.format("interpellation_text") + """
    SELECT f.object_id, f.rid AS response_id, f.num AS response_number, coalesce(left(m.dd, 4), cast(m.y AS VARCHAR), nullif(regexp_extract(f.num, '\\b(20\\d{2})\\b', 1), '')) AS response_year, f.num AS reference
    FROM (SELECT object_id, arg_min(rid, no) FILTER (WHERE true) AS a, min(no) AS no FROM x GROUP BY object_id) g JOIN x f ON f.object_id = g.object_id AND f.no = g.no LEFT JOIN m ON m.document_id = f.rid""")
def _(s, d):
    own, links, responses = stored(s, d, "interpellation_text")
    return objects.answered(own, own_entries(own), links, responses).drop("response_date")


@query("answered_in_year", "V11", "WITH " + _ENTRIES.format("interpellation_text") + """, z AS (SELECT x.*, coalesce(left(m.dd, 4), cast(m.y AS VARCHAR), nullif(regexp_extract(num, '\\b(20\\d{2})\\b', 1), '')) AS yr FROM x LEFT JOIN m ON m.document_id = x.rid)
    SELECT object_id, arg_min(rid, no) AS response_id FROM z WHERE yr = '2024' AND rid IS NOT NULL GROUP BY object_id""")
def _(s, d):
    own, links, responses = stored(s, d, "interpellation_text")
    return objects.answered(own, own_entries(own), links, responses, year="2024").where("response_id is not null").select("object_id", "response_id")


@query("unanswered_interpellations", "V13 D8", "WITH " + _LINKS.format("interpellation_text") + " SELECT object_id, dd AS political_date, coalesce(left(dd, 4), cast(y AS VARCHAR)) AS filed FROM o WHERE object_id NOT IN (SELECT object_id FROM l)")
def _(s, d):
    own, links, responses = stored(s, d, "interpellation_text")
    return objects.unanswered(own, links, responses)


def flagged(s, d):
    own, links, responses = stored(s, d, "postulat_text")
    has = own.join(links.select("object_id").distinct().withColumn("linked", lit(True)), "object_id", "left")
    return has.select("object_id", "listing_year", c("political_date").alias("deposit_date"), c("political_date").alias("response_date"), F.when(F.length("object_id") % 3 > 0, c("linked")).alias("has_response")), links, responses


@query("answered_postulates", "V12", "WITH " + _LINKS.format("postulat_text") + " SELECT object_id, arg_min(rid, pos) AS response_id, any_value(o.dd) AS response_date FROM o JOIN l USING (object_id) WHERE length(object_id) % 3 > 0 GROUP BY object_id")
def _(s, d):
    return objects.answered_flagged(*flagged(s, d))


@query("unanswered_postulates", "V14", "WITH " + _LINKS.format("postulat_text") + " SELECT object_id, coalesce(left(dd, 4), cast(y AS VARCHAR)) AS filed FROM o WHERE NOT (length(object_id) % 3 > 0 AND object_id IN (SELECT object_id FROM l))")
def _(s, d):
    return objects.unanswered_flagged(flagged(s, d)[0])


@query("deduplicated_documents", "R6", """
    WITH k AS (SELECT doc_id, source, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'œ', '#'), 'Œ', '#'))), '[^a-z0-9]+', ' ', 'g')) AS w, text, coalesce(document_date, '') AS day, coalesce(category, '-') AS cat FROM documents),
    g AS (SELECT source, CASE WHEN length(w) >= 120 THEN md5(w) ELSE md5(text) || '!' END AS i, * EXCLUDE (source) FROM k)
    SELECT max_by(cast(doc_id AS VARCHAR), (day, cast(doc_id AS VARCHAR))) AS document_id, source AS role, list_sort(list_distinct(list(cat))) AS object_ids FROM g GROUP BY source, i""")
def _(s, d):
    rows = table(s, d, "documents").select(c("doc_id").cast("string").alias("document_id"), c("source").alias("role"), "text", F.sha2("text", 256).alias("byte_hash"), c("document_date").alias("day"), F.coalesce("category", lit("-")).alias("object_id"))
    return objects.deduplicated(rows)[0]


@query("attachments_once", "R7", """
    SELECT o_custkey AS object_id, h AS content_hash, max(o_orderkey) FILTER (WHERE r = m) AS download_id, CASE m WHEN 3 THEN 'Réponse' WHEN 2 THEN 'Annexe' ELSE 'Autre' END AS type, list_sort(list_filter(list(DISTINCT o_orderkey), x -> x <> max(o_orderkey) FILTER (WHERE r = m))) AS aliases
    FROM (SELECT *, max(r) OVER (PARTITION BY o_custkey, h) AS m FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS h, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS r FROM orders)) GROUP BY o_custkey, h, m""".replace("x ->", "lambda x:"))
def _(s, d):
    kind = F.when(c("o_orderstatus") == "F", "Réponse").when(c("o_orderstatus") == "O", "Annexe").otherwise("Autre")
    return objects.attachments_once(table(s, d, "orders").select(c("o_custkey").alias("object_id"), c("o_orderpriority").alias("content_hash"), kind.alias("type"), c("o_orderkey").alias("download_id")))


@query("primary_attachments", "R14", "SELECT l_orderkey AS object_id, arg_min(l_partkey, (CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END, l_linenumber, l_partkey)) AS download_id FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("object_id"), c("l_linenumber").alias("position"), c("l_partkey").alias("download_id"), F.when(c("l_returnflag") == "R", "Préavis").otherwise("Annexe").alias("type"), F.when(c("l_linestatus") == "F", "Rapport_1.pdf").otherwise("Lettre.pdf").alias("name"))
    return objects.primary_attachment(rows)


@query("response_candidates", "R13 Z52", """
    SELECT DISTINCT document_id, CASE WHEN role = 'municipal_response' THEN 'ri_reference' WHEN role = 'interpellation_text' THEN 'response_title' END AS reason, CASE WHEN role IN ('municipal_response', 'interpellation_text') THEN 'taken' ELSE 'no_reference_or_title' END AS verdict FROM (SELECT document_id, document_role AS role FROM document_metadata)""")
def _(s, d):
    rows = docs(s, d).select("document_id", "document_role").distinct()
    reference = F.when(c("document_role") == "municipal_response", cat(lit("2021/RI 0"), F.length("document_id")))
    title = F.when(c("document_role") == "interpellation_text", "Réponse municipale à l’interpellation X").otherwise("Interpellation X")
    taken, rest = objects.split_candidates(rows, objects.candidate_reason(reference, title), lit("no_reference_or_title"))
    none = rest.select("document_id", lit(None).cast("string").alias("reason"), c("reason").alias("verdict"))
    return taken.select("document_id", "reason", lit("taken").alias("verdict")).unionByName(none)


@query("first_and_last_source", "U3 U4", "SELECT k, CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 0 ELSE 1 END AS first_source, CASE WHEN k IN (SELECT s_suppkey * 20 FROM supplier) THEN 1 ELSE 0 END AS last_source FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey * 20 FROM supplier)")
def _(s, d):
    a, b = table(s, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("v")), table(s, d, "supplier").select((c("s_suppkey") * 20).alias("k"), c("s_name").alias("v"))
    first, last = objects.first_source_wins([a, b], "k"), objects.last_source_wins([a, b], [c("k")])
    return first.select("k", c("source_no").alias("first_source")).join(last.select("k", c("source_no").alias("last_source")), "k")


@query("canonical_links", "J14 R12", """
    SELECT l_orderkey AS link_id, CASE WHEN l_partkey % 3 = 0 THEN 'o' || l_partkey WHEN l_partkey % 3 = 1 AND l_suppkey % 3 = 0 THEN 'o' || l_suppkey WHEN l_suppkey % 3 = 0 THEN 'o' || l_suppkey END AS object_id, CASE WHEN l_partkey % 3 = 0 THEN 'url' WHEN l_partkey % 3 = 1 THEN 'id' ELSE 'id' END AS way
    FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey) WHERE l_partkey % 3 = 0 OR l_suppkey % 3 = 0""")
def _(s, d):
    links = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("link_id")).agg(cat(lit("u"), F.min("l_partkey")).alias("url"), cat(lit("o"), F.min("l_suppkey")).alias("related_id"))
    known = table(s, d, "part").select(cat(lit("u"), c("p_partkey")).alias("url"), cat(lit("o"), c("p_partkey")).alias("object_id"), (c("p_partkey") % 3 == 0).alias("canonical"), lit(None).cast("string").alias("related_id"))
    return objects.canonical_objects(links, known)


@query("indirect_links", "J14", "SELECT o_orderkey AS link_id, 'o' || (o_custkey % 500 * 2) AS object_id, CASE WHEN o_custkey % 2 = 0 THEN 'url' ELSE 'indirect' END AS way FROM orders WHERE o_custkey % 1000 > 0")
def _(s, d):
    # even URLs are canonical objects, odd ones are related to that of twice their number
    url = c("o_custkey") % 1000
    links = table(s, d, "orders").where(url > 0).select(c("o_orderkey").alias("link_id"), F.when(c("o_custkey") % 2 == 0, cat(lit("u"), c("o_custkey") % 500 * 2)).otherwise(cat(lit("v"), url)).alias("url"), lit(None).cast("string").alias("related_id"))
    n = s.range(1000)
    even = n.where("id % 2 = 0").select(cat(lit("u"), c("id")).alias("url"), cat(lit("o"), c("id")).alias("object_id"), lit(True).alias("canonical"), lit(None).cast("string").alias("related_id"))
    odd = n.where("id % 2 = 1").select(cat(lit("v"), c("id")).alias("url"), lit(None).cast("string").alias("object_id"), lit(False).alias("canonical"), cat(lit("o"), c("id") % 500 * 2).alias("related_id"))
    return objects.canonical_objects(links, even.unionByName(odd))


@query("recovered_downloads", "J18", "SELECT c_custkey, CASE WHEN s.k IS NOT NULL THEN s.k END AS equivalent_id FROM customer LEFT JOIN (SELECT lower(replace(s_name, '#', ' ')) AS t, max(cast(s_suppkey AS VARCHAR)) AS k FROM supplier GROUP BY 1) s ON replace(lower(replace(c_name, '#', ' ')), 'customer', 'supplier') = s.t")
def _(s, d):
    failed = table(s, d, "customer").select("c_custkey", F.replace("c_name", lit("Customer#"), lit("  SÜPPLIER – ")).alias("title"))
    return objects.recovered_downloads(failed, table(s, d, "supplier").select(c("s_suppkey").cast("string").alias("document_id"), c("s_name").alias("title"))).select("c_custkey", "equivalent_id")


@query("hinted_authors", "Z5", "SELECT DISTINCT document_id, CASE WHEN strip_accents(lower(title)) LIKE '%ecole%' THEN 'A' WHEN strip_accents(lower(title)) LIKE '%lac%' THEN 'B' WHEN strip_accents(lower(title)) LIKE '%route%' THEN 'C' END AS author FROM document_metadata WHERE title IS NOT NULL AND NOT contains(title, '�') AND NOT regexp_matches(title, '[ÃÂâ€]')")
def _(s, d):
    hints = s.createDataFrame([(2, "lac", "B"), (1, "École", "A"), (3, "route", "C"), (4, "", "D")], "position int, hint string, author string")
    return objects.hinted_authors(docs(s, d).where("title is not null").where(~c("title").rlike("[�ÃÂâ€]")).select("document_id", "title"), hints).distinct()


@query("agenda_inherited", "Z8", """
    SELECT document_id, CASE WHEN len(document_id) % 2 = 0 THEN ['A'] ELSE ['O'] END AS authors, coalesce(t, 'titre') AS title, ck AS object_id, true AS agenda_linked FROM (SELECT document_id, max(title) AS t, max(commune_key) AS ck FROM document_metadata GROUP BY document_id) WHERE ck IN (SELECT commune_key FROM municipalities)
    UNION ALL SELECT document_id, CASE WHEN len(document_id) % 2 = 0 THEN ['A'] END, t, NULL, false FROM (SELECT document_id, max(title) AS t, max(commune_key) AS ck FROM document_metadata GROUP BY document_id) WHERE ck IS NULL OR ck NOT IN (SELECT commune_key FROM municipalities)""")
def _(s, d):
    rows = once(s, d)
    own = rows.select("document_id", F.when(F.length("document_id") % 2 == 0, F.array(lit("A"))).alias("authors"), "title")
    towns = table(s, d, "municipalities").select(c("commune_key").alias("object_id"), F.array(lit("O")).alias("authors"), lit("titre").alias("title"))
    return objects.inherited(own, rows.select("document_id", c("commune_key").alias("object_id")), towns)


def assembled(s, d):
    lines = table(s, d, "lineitem").select(c("l_orderkey").alias("session_id"), c("l_linenumber").cast("string").alias("number"), c("l_suppkey").alias("position"), c("l_partkey").cast("string").alias("document_id")).distinct()
    agenda = table(s, d, "orders").select(c("o_orderkey").alias("session_id"), F.explode(F.array(lit("1"), lit("2"))).alias("number")).withColumn("title", cat(lit("Point "), c("number")))
    parts = table(s, d, "part").where("p_size > 10").select(c("p_partkey").cast("string").alias("document_id"), cat(F.when(c("p_size") > 30, "Préavis ").otherwise("Divers "), c("p_partkey")).alias("title"))
    return objects.sessions(agenda, lines, parts)


@query("session_items", "Z9", """
    SELECT o_orderkey AS session_id, n AS number, (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_orderkey = o_orderkey AND cast(l_linenumber AS VARCHAR) = n) AS documents FROM orders, (SELECT unnest(['1', '2']) AS n)""")
def _(s, d):
    return assembled(s, d).select("session_id", F.explode("items").alias("i")).select("session_id", "i.number", F.size("i.documents").cast("long").alias("documents"))


@query("flattened_sessions", "Z19", "SELECT DISTINCT l_orderkey AS session_id, cast(l_linenumber AS VARCHAR) AS number, l_suppkey AS s, cast(l_partkey AS VARCHAR) AS document_id, CASE WHEN p_size > 30 THEN 'preavis-municipal' ELSE 'autre' END AS category FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 2".replace("SELECT DISTINCT", "SELECT * EXCLUDE (s) FROM (SELECT DISTINCT") + ")")
def _(s, d):
    return objects.flattened(assembled(s, d), {"preavis": "preavis-municipal", "motion": "motion"})


@query("object_occurrences", "Z29 Z56", "SELECT commune_key AS object_id, min(document_date) AS deposited, max(document_date) AS considered, count(DISTINCT (document_date, source)) AS n FROM documents WHERE document_date BETWEEN '2021-07-01' AND '2026-06-30' AND commune_key IS NOT NULL GROUP BY commune_key")
def _(s, d):
    rows = table(s, d, "documents").where("commune_key is not null").select(c("commune_key").alias("object_id"), c("document_date").alias("day"), c("source").alias("url"))
    return objects.occurrences(rows, ("2021-07-01", "2026-06-30")).select("object_id", "deposited", "considered", F.size("sessions").cast("long").alias("n"))


@query("session_references", "Z10", "SELECT commune_key AS object_id, string_agg(day || '/' || item, ' ' ORDER BY day, item) AS sessions FROM (SELECT commune_key, '2015-01-01' AS day, 'x' AS item FROM municipalities UNION SELECT commune_key, document_date, category FROM documents WHERE document_date IS NOT NULL AND category IS NOT NULL AND commune_key IN (SELECT commune_key FROM municipalities)) GROUP BY commune_key")
def _(s, d):
    ref = F.struct(lit("2015-01-01").alias("day"), lit("x").alias("item"))
    own = table(s, d, "municipalities").select(c("commune_key").alias("object_id"), F.array(ref, ref).alias("sessions"))
    new = table(s, d, "documents").where("document_date is not null and category is not null").select(c("commune_key").alias("object_id"), c("document_date").alias("day"), c("category").alias("item"))
    return objects.session_references(own, new).select("object_id", F.array_join(F.transform("sessions", lambda x: cat(x["day"], lit("/"), x["item"])), " ").alias("sessions"))


@query("object_documents", "Z24", """
    SELECT o_orderkey || '' AS object_id, o_orderkey || '_text' AS document_id, 'object_text' AS role FROM orders
    UNION ALL SELECT DISTINCT l_orderkey || '', l_orderkey || '_response_0' || l_linenumber, CASE WHEN f = 'R' THEN 'municipal_response_html' ELSE 'municipal_response' END FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) WHERE f <> 'N'""")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    answers = lines.select(c("l_orderkey").cast("string").alias("object_id"), c("l_linenumber").alias("no"), F.when(c("f") == "A", "https://x.example/a.pdf").otherwise("").alias("pdf_url"), F.when(c("f") == "R", "<p>x</p>").alias("html"))
    return objects.fan_out(table(s, d, "orders").select(c("o_orderkey").cast("string").alias("object_id")), answers).drop("pdf_url")


_KEYED = "SELECT document_id, role, t, dd, ca, ck || '-' || y AS k FROM m WHERE ck IS NOT NULL AND y IS NOT NULL"


@query("object_relations", "J17 Z25", "WITH " + _M + f", r AS ({_KEYED}) SELECT k AS object_key, min(document_id) FILTER (WHERE suffix(role, '_text')) AS object_id, count(*) FILTER (WHERE role = 'municipal_response') AS responses, count(*) FILTER (WHERE contains(role, 'report')) AS reports, count(*) FILTER (WHERE contains(role, 'decision')) AS decisions FROM r GROUP BY k")
def _(s, d):
    keyed = once(s, d).where("commune_key is not null and listing_year is not null").withColumn("object_key", F.concat_ws("-", "commune_key", "listing_year"))
    found = objects.relationships(keyed)
    return found.select("object_key", "object_id", *[F.size(f"{x}_ids").cast("long").alias(f"{x}s") for x in ("response", "report", "decision")])


@query("metadata_records", "Z7 Z26 X10", "WITH " + _M + f", r AS ({_KEYED}), g AS (SELECT k, min(document_id) FILTER (WHERE suffix(role, '_text')) AS o, count(*) FILTER (WHERE role = 'municipal_response') AS n FROM r GROUP BY k) SELECT document_id, t AS title, left(dd, 4) AS year, CASE WHEN g.o <> document_id THEN g.o END AS object_id, CASE WHEN n > 0 THEN n END AS responses FROM r JOIN g USING (k)")
def _(s, d):
    keyed = once(s, d).where("commune_key is not null and listing_year is not null").withColumn("object_key", F.concat_ws("-", "commune_key", "listing_year"))
    rows = objects.metadata_records(keyed, objects.relationships(keyed))
    read = F.from_json("record", "document_metadata struct<title:string,document_year:string>, relationships struct<object_id:string,response_document_ids:array<string>>")
    return rows.select("document_id", read.alias("r")).select("document_id", "r.document_metadata.title", c("r.document_metadata.document_year").alias("year"), "r.relationships.object_id", F.when(F.size("r.relationships.response_document_ids") > 0, F.size("r.relationships.response_document_ids").cast("long")).alias("responses"))


@query("merged_links", "R4 Z28", """
    SELECT o_orderkey AS object_id, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS responses, coalesce((SELECT CASE WHEN max(l_quantity) >= 49 THEN 'exact' WHEN max(l_quantity) >= 38 THEN 'probable' ELSE 'manual' END FROM lineitem WHERE l_orderkey = o_orderkey HAVING count(*) > 0), 'none') AS link_status FROM orders""")
def _(s, d):
    from civicspark.operators import dedup

    score = F.max("l_quantity") / 50
    links = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("object_id"), c("l_linenumber").cast("string").alias("response_id")).agg(score.alias("score")).withColumn("tier", dedup.tier(c("score"), lit(0.2)))
    return objects.merged_links(table(s, d, "orders").select(c("o_orderkey").alias("object_id")), links).select("object_id", F.size("response_ids").cast("long").alias("responses"), "link_status")


@query("document_keys", "Z36", "SELECT DISTINCT chunk_id, CASE WHEN chunk_hash IS NOT NULL AND length(chunk_id) % 3 = 0 THEN chunk_hash WHEN length(chunk_id) % 3 = 1 AND section_title IS NOT NULL AND section_title <> '' THEN section_title ELSE split_part(chunk_id, '#', 1) END AS key FROM chunks")
def _(s, d):
    third = F.length("chunk_id") % 3
    fields = [F.when(third == 0, c("chunk_hash")), lit(""), lit(None).cast("string"), F.when(third == 1, c("section_title"))]
    return chunks(s, d).select("chunk_id", objects.document_key(fields, c("chunk_id")).alias("key")).distinct()


@query("answer_context", "Z37", """
    SELECT string_agg('[Source ' || n || '] ' || source || ' | Commune: ' || ck || chr(10) || ps, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT source, coalesce(min(commune_key) FILTER (WHERE false), 'commune non précisée') AS ck, row_number() OVER (ORDER BY count(*) DESC, source) AS n,
      'Passage 1:' || chr(10) || count(*) || ' documents' AS ps FROM documents GROUP BY source)""")
def _(s, d):
    rows = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    results = rows.select(c("source").alias("document_id"), c("source").alias("title"), lit(None).cast("string").alias("commune"), c("n").cast("double").alias("score"), c("source").alias("place"), cat(c("n"), lit(" documents")).alias("content"))
    return objects.context(results)


@query("stored_summaries", "Z38", "SELECT c_custkey || '' AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'S' || c_custkey ELSE c_name END AS summary FROM customer")
def _(s, d):
    rows = table(s, d, "customer").select(c("c_custkey").cast("string").alias("document_id"), "c_name")
    stored_ = table(s, d, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").cast("string").alias("document_id"), F.when(c("c_custkey") % 4 == 0, cat(lit("S"), c("c_custkey"))).otherwise("  ").alias("summary"))
    return objects.with_summaries(rows, stored_, c("c_name")).select("document_id", "summary")


@query("document_specs", "Z49", "SELECT pdf_url AS url, CASE WHEN pdf_url IN (SELECT file_url FROM document_metadata) THEN 'curated' ELSE 'catalogue' END AS origin FROM (SELECT file_url AS pdf_url FROM document_metadata WHERE file_url IS NOT NULL UNION SELECT pdf_url FROM site_inventory WHERE pdf_url IS NOT NULL)")
def _(s, d):
    curated = docs(s, d).where("file_url is not null").select(c("file_url").alias("url")).distinct()
    return objects.document_specs(curated, table(s, d, "site_inventory").where("pdf_url is not null").select(c("pdf_url").alias("url")))


@query("schema_fields", "Z50", "SELECT 'title' AS name, 'string' AS type, bool_or(title IS NULL) AS lacking FROM document_metadata UNION ALL SELECT 'listing_year', 'integer', bool_or(listing_year IS NULL) FROM document_metadata UNION ALL SELECT 'authors', 'array', bool_or(authors IS NULL) FROM document_metadata UNION ALL SELECT 'document_id', 'string', false")
def _(s, d):
    return s.createDataFrame(objects.schema_fields(docs(s, d).select("title", "listing_year", "authors", "document_id")), "name string, type string, lacking boolean")


@query("publication_gate", "Z55", "SELECT l_orderkey, CASE WHEN min(l_discount) >= 0.02 AND max(l_quantity) >= 38 THEN 'validated' ELSE 'needs_review' END AS status FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("a"), F.max("l_quantity").alias("q"))
    tier = F.when(c("q") >= 49, "exact").when(c("q") >= 38, "probable").otherwise("manual")
    return rows.select("l_orderkey", objects.publication(c("a") < 0.02, tier).alias("status"))


@query("question_answered", "N4 V11", "WITH " + _LINKS.format("interpellation_text") + " SELECT object_id, arg_min(rid, pos) AS response_id FROM l JOIN m ON m.document_id = l.object_id WHERE m.ca = 'interpellation' GROUP BY object_id")
def _(s, d):
    from civicspark.plans import question

    spec = question.understand("Quelles interpellations ont reçu une réponse ?", {})
    links = stored(s, d, "interpellation_text")[1]
    return question.compile_spec(spec, docs(s, d), chunks(s, d), links=links).select("object_id", "response_id")


@query("response_statuses", "A15 A16", "WITH " + _LINKS.format("interpellation_text") + " SELECT CASE WHEN object_id IN (SELECT object_id FROM l) THEN 'answered' ELSE 'pending' END AS status, count(*) AS n, count(*) FILTER (WHERE object_id IN (SELECT object_id FROM l JOIN ns USING (rid))) AS with_summary FROM o GROUP BY 1")
def _(s, d):
    own, links, responses = stored(s, d, "interpellation_text")
    summed = links.join(responses.where("numbers is not null"), "response_id", "left_semi").select("object_id").distinct().withColumn("summary", lit(True))
    state = own.join(links.select("object_id").distinct().withColumn("linked", lit(True)), "object_id", "left").join(summed, "object_id", "left")
    return state.groupBy(F.when(c("linked"), "answered").otherwise("pending").alias("status")).agg(F.count("*").alias("n"), F.count_if("summary").alias("with_summary"))


@query("identical_records", "A18", """
    SELECT count(*) AS records, count(*) FILTER (WHERE a = b AND t = u) AS all_identical, count(*) FILTER (WHERE a = b) AS tag_identical FROM (SELECT pdf_url, coalesce(max(etag) FILTER (WHERE snapshot_no <= 3), '') AS a, coalesce(max(etag) FILTER (WHERE snapshot_no > 3), '') AS b, coalesce(trim(regexp_replace(max(title) FILTER (WHERE snapshot_no <= 3), '[\\s\\x{A0}]+', ' ', 'g')), '') AS t, coalesce(trim(regexp_replace(max(title) FILTER (WHERE snapshot_no > 3), '[\\s\\x{A0}]+', ' ', 'g')), '') AS u FROM site_inventory GROUP BY pdf_url)""")
def _(s, d):
    from civicspark.operators import quality

    half = lambda cond: table(s, d, "site_inventory").where(cond).groupBy("pdf_url").agg(F.max("etag").alias("etag"), F.max("title").alias("title"))
    status = quality.compare_records(half("snapshot_no <= 3"), half("snapshot_no > 3"), "pdf_url", ["etag", "title"])
    same = c("status").isin("identical", "both_missing")
    each = status.groupBy("pdf_url").agg(F.bool_and(same).alias("all"), F.bool_or((c("field") == "etag") & same).alias("tag"))
    return each.agg(F.count("*").alias("records"), F.count_if("all").alias("all_identical"), F.count_if("tag").alias("tag_identical"))


@query("other_sources", "U5 X7", "SELECT commune_key, source, array_to_string(list_sort(list_filter((SELECT list(DISTINCT d.source) FROM documents d WHERE d.commune_key = x.commune_key), lambda v: v <> x.source)), ',') AS others FROM (SELECT DISTINCT commune_key, source FROM documents WHERE commune_key IS NOT NULL) x")
def _(s, d):
    sets = table(s, d, "documents").where("commune_key is not null").groupBy("commune_key").agg(F.collect_set("source").alias("all"))
    each = table(s, d, "documents").where("commune_key is not null").select("commune_key", "source").distinct().join(sets, "commune_key")
    return each.select("commune_key", "source", F.array_join(F.sort_array(F.array_except(F.array_union("all", F.array("source")), F.array("source"))), ",").alias("others"))


@query("url_categories", "Z47 D22", "SELECT DISTINCT pdf_url, CASE WHEN contains(lower(pdf_url), 'proces-verbaux') THEN 'proces-verbaux' WHEN contains(lower(pdf_url), 'preavis') THEN 'preavis-municipaux' WHEN contains(lower(pdf_url), 'communications') THEN 'communications-municipales' WHEN contains(lower(pdf_url), 'rapport-de-gestion') THEN 'rapport-de-gestion' ELSE 'autres' END AS category, coalesce(nullif(regexp_extract(pdf_url, '/(20\\d{2})/', 1), ''), nullif(regexp_extract(regexp_extract(pdf_url, '([^/]*)$', 1), '(20\\d{2})', 1), ''), '1999') AS year FROM site_inventory WHERE pdf_url IS NOT NULL AND NOT regexp_matches(pdf_url, '[%?#+]')")
def _(s, d):
    rows = table(s, d, "site_inventory").where("pdf_url is not null").where(~c("pdf_url").rlike("[%?#+]")).select("pdf_url").distinct()
    return rows.select("pdf_url", records.url_category(c("pdf_url")).alias("category"), records.url_year_or(c("pdf_url"), lit("1999")).alias("year"))


@query("mixed_url_categories", "Z47 D22", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'interpellations' WHEN 1 THEN 'postulats' ELSE 'budget' END AS category, '2021' AS year, CASE doc_id % 3 WHEN 0 THEN 'Interpellation-' ELSE 'postulat_' END || doc_id || '-' || left(sha1('https://x.example/' || (CASE doc_id % 3 WHEN 2 THEN 'budget' ELSE 'motions-postulats' END) || '/2021/' || CASE doc_id % 3 WHEN 0 THEN 'Interpellation-' ELSE 'postulat_' END || doc_id || '.pdf'), 8) AS id FROM documents")
def _(s, d):
    from civicspark.functions import dates

    third = c("doc_id") % 3
    url = cat(lit("https://x.example/"), F.when(third == 2, "budget").otherwise("motions-postulats"), lit("/2021/"), F.when(third == 0, "Interpellation-").otherwise("postulat_"), c("doc_id"), lit(".pdf"))
    return council(s, d).select("doc_id", records.url_category(url).alias("category"), records.url_year_or(url, lit("x")).alias("year"), dates.url_id(url).alias("id"))


@query("authors_of_all_categories", "X6 T15 T19", """
    SELECT document_id, CAST(len(list_distinct(list_transform(list_filter(authors, lambda a: trim(coalesce(a.name, '')) <> ''), lambda a: CASE WHEN a.party IS NOT NULL AND NOT contains(CASE WHEN a.civility IS NOT NULL AND NOT starts_with(a.name, a.civility) THEN a.civility || ' ' || a.name ELSE a.name END, '(' || a.party) THEN (CASE WHEN a.civility IS NOT NULL AND NOT starts_with(a.name, a.civility) THEN a.civility || ' ' || a.name ELSE a.name END) || ' (' || a.party || ')' ELSE (CASE WHEN a.civility IS NOT NULL AND NOT starts_with(a.name, a.civility) THEN a.civility || ' ' || a.name ELSE a.name END) END))) AS INTEGER) AS authors
    FROM (SELECT document_id, arg_max(authors, loaded_at) AS authors FROM document_metadata WHERE authors IS NOT NULL GROUP BY document_id)""")
def _(s, d):
    rows = docs(s, d).where("authors is not null").groupBy("document_id").agg(F.max_by("authors", "loaded_at").alias("authors"))
    both = F.create_map(lit("motion_metadata"), c("authors"), lit("postulate_metadata"), c("authors"))
    return rows.select("document_id", F.size(records.all_authors(both)).alias("authors"))


@query("author_years", "Z39", f"SELECT DISTINCT trim(lower(translate(a.name, '{text.MARKED}', '{text.BASE}'))) AS author, coalesce(cast(y AS VARCHAR), '') AS year FROM (SELECT unnest(authors) AS a, listing_year AS y FROM document_metadata) WHERE trim(coalesce(a.name, '')) <> ''")
def _(s, d):
    from civicspark.operators import browse

    return browse.author_years(docs(s, d))


@query("result_rows", "F22", """
    SELECT chunk_id AS id, document_id, t AS title, ca AS doc_type, length(content) AS chars, coalesce(nullif(fu, ''), nullif(pu, ''), '') AS source_url, 0.9 AS score, 'keyword' AS search_source, (t IS NOT NULL AND t <> '')::INT + (ca IS NOT NULL)::INT + 1 AS fields FROM (SELECT DISTINCT chunk_id, document_id, content FROM chunks) JOIN (SELECT document_id, max(title) AS t, max(category) AS ca, max(file_url) AS fu, max(source_page_url) AS pu FROM document_metadata GROUP BY document_id) USING (document_id)""")
def _(s, d):
    from civicspark.operators import browse

    titles = docs(s, d).groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("title", "category", "file_url", "source_page_url")])
    rows = chunks(s, d).select("chunk_id", "document_id", "content").distinct().join(titles, "document_id").withColumn("summary", lit("")).withColumn("score", lit(0.9))
    shaped = browse.result_rows(rows, "keyword")
    return shaped.select("id", "document_id", "title", "doc_type", F.length("text").alias("chars"), "source_url", c("score").cast("decimal(2,1)").alias("score"), "search_source", F.size("metadata").alias("fields"))
