"""Queries on sections of texts: composed from table rows, cut by the operators, and held against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.catalog import c, chunks, docs, query
from civicspark.catalog_records import cat, council, lit
from civicspark.functions import dates
from civicspark.operators import segment
from civicspark.sources.tables import table

#: A paragraph that is longer than the gap between two headings.
LONG = "mot " * 70


@query("response_parts", "G4 G5", """
    SELECT doc_id, 0 AS no, CASE doc_id % 3 WHEN 2 THEN 'municipal_response' ELSE 'interpellation_text' END AS component, CASE doc_id % 3 WHEN 2 THEN 'Réponse municipale 4/2021' ELSE 'Interpellation' END AS section_title, CASE doc_id % 3 WHEN 2 THEN '4/2021' END AS response_number FROM documents
    UNION ALL SELECT doc_id, 1, CASE doc_id % 3 WHEN 2 THEN 'interpellation_text' ELSE 'municipal_response' END, CASE doc_id % 3 WHEN 0 THEN 'Réponse municipale ' || (doc_id % 9 + 1) || '/2022' WHEN 1 THEN 'Réponse municipale' ELSE 'Interpellation annexée' END, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 9 + 1) || '/2022' END FROM documents
    UNION ALL SELECT doc_id, 2, 'municipal_response', 'Réponse municipale orale', NULL FROM documents WHERE doc_id % 3 = 0""")
def _(s, d):
    third = c("doc_id") % 3
    body = F.when(third == 0, cat(lit("Le lac et " + LONG + "\nRéponse municipale N° "), c("no"), lit("/2022 du conseil\nTexte\nRÉPONSE MUNICIPALE ORALE\nTexte"))).when(third == 1, lit("Le lac\nDonc La Municipalité répond comme suit :\nNon.")).otherwise(
        lit("Réponse à l’interpellation\nRÉPONSE MUNICIPALE N° 4/2021\nTexte\nInterpellation : le lac\nQue faire ?")
    )
    parts = council(s, d).select("doc_id", F.posexplode(segment.response_sections(body)).alias("no", "x"))
    return parts.select("doc_id", "no", "x.component", "x.section_title", "x.response_number")


@query("motion_parts", "G6", """
    SELECT doc_id, 0 AS no, 'motion_text' AS component, 'Motion' AS section_title, length('Texte ' || source || ' ') + 279 AS chars FROM documents
    UNION ALL SELECT doc_id, 1, 'commission_report', CASE WHEN doc_id % 2 = 0 THEN 'Rapport de majorité' ELSE 'Rapport de commission' END, 30 + 280 - 1 FROM documents
    UNION ALL SELECT doc_id, 2, 'commission_report', 'Rapport de minorité', 22 + 279 FROM documents UNION ALL SELECT doc_id, 3, 'council_decision', 'Décision du Conseil communal', 31 FROM documents""")
def _(s, d):
    body = cat(lit("Texte "), c("source"), lit(" " + LONG + "\nRapport de la commission\nmajo\n" + LONG + "\n\n  Rapport de minorité 1\n" + LONG + "\nExtrait du procès-verbal du 3.4"))
    kind = F.when(c("doc_id") % 2 == 0, "majority_and_minority_reports").otherwise("standard_report")
    parts = council(s, d).select("doc_id", F.posexplode(segment.motion_sections(body, lit("combined_motion_report"), kind)).alias("no", "x"))
    return parts.select("doc_id", "no", "x.component", "x.section_title", F.length("x.content").alias("chars"))


@query("postulate_parts", "G7", """
    SELECT doc_id, 0 AS no, 'postulat_text' AS component, 'Postulat' AS section_title, 'Postulat de ' || source || chr(10) || trim(repeat('mot ', 70)) AS content FROM documents UNION ALL SELECT doc_id, 1, 'commission_report', 'Rapport de commission', '**Rapport relatif à la prise en considération' || chr(10) || 'Décision du Conseil communal ' || (doc_id % 9 + 1) FROM documents""")
def _(s, d):
    body = cat(lit("12\n\nPostulat de "), c("source"), lit("\n" + LONG + "\n**Rapport relatif à la prise en considération\nDécision du Conseil communal "), c("no"))
    parts = council(s, d).select("doc_id", F.posexplode(segment.postulate_sections(body, lit("postulat_text"), lit(None).cast("string"))).alias("no", "x"))
    return parts.select("doc_id", "no", "x.component", "x.section_title", "x.content")


@query("preavis_parts", "G8", """
    SELECT doc_id, 0 AS no, 'municipal_preavis' AS component, 'Préavis ' AS head FROM documents UNION ALL SELECT doc_id, 1, 'appendix', 'Annexes ' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, 'commission_report', 'Rapport ' FROM documents WHERE doc_id % 3 > 0
    UNION ALL SELECT doc_id, 2, 'council_decision', CASE WHEN doc_id % 3 = 1 THEN 'Décision' ELSE 'd é c i ' END FROM documents WHERE doc_id % 3 > 0""")
def _(s, d):
    third = c("doc_id") % 3
    body = cat(
        lit("Préavis "), c("source"), lit("\nRapport de la commission ..... 3\nDécision ..... 9\n" + LONG + "\n"), F.when(third == 0, "Annexes :\n" + LONG + "\nDécision du Conseil communal\n").otherwise("Rapport de la commission des finances\n" + LONG + "\nRapport de commission\n"), lit(LONG),
        F.when(third == 1, "\nDécision\n" + LONG).when(third == 2, "\nd é c i d e :\nFin").otherwise("\nFin"),
    )
    role = F.when(third == 0, "municipal_preavis").otherwise("combined_preavis_report_decision")
    parts = council(s, d).select("doc_id", F.posexplode(segment.preavis_sections(body, role)).alias("no", "x"))
    return parts.select("doc_id", "no", "x.component", F.left("x.content", lit(8)).alias("head"))


@query("annual_parts", "G10", "SELECT doc_id, 0 AS no, 'annual_management_report' AS component, left(source, 6) AS head FROM documents UNION ALL SELECT doc_id, 1, 'commission_report', '## RAP' FROM documents UNION ALL SELECT doc_id, 2, 'municipal_response', 'Répons' FROM documents")
def _(s, d):
    # the extract stands too near to the heading before it
    body = cat(c("source"), lit("\n" + LONG + "\n## RAPPORT DE LA COMMISSION DE GESTION\nEXTRAIT DU PROCÈS-VERBAL 11\n" + LONG + "\nRéponses de la Municipalité ok"))
    parts = council(s, d).select("doc_id", F.posexplode(segment.annual_sections(body)).alias("no", "x"))
    return parts.select("doc_id", "no", "x.component", F.left("x.content", lit(6)).alias("head"))


def minutes(s, d):
    """Minutes of one session for each order, an agenda item for each line item."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("p")))).alias("ls"))
    once = F.filter("ls", lambda x, i: (i == 0) | (F.get("ls", i - 1)["n"] != x["n"]))
    title = lambda x: cat(lit("Préavis "), x["p"].cast("string"), lit(" relatif au lac"))
    agenda = F.array_join(F.transform(once, lambda x: cat(x["n"].cast("string"), lit(". Préavis "), x["p"].cast("string"), lit(" rela-\ntif au  lac\n"))), "")
    body = F.array_join(F.transform(once, lambda x: cat(x["n"].cast("string"), lit(". "), title(x), lit("\nDiscussion.\n9. Rien à voir\n"))), "")
    return lines.select("l_orderkey", cat(lit("PV\nORDRE DU JOUR\n"), agenda, lit("Appel\nLe Président ouvre.\n"), body).alias("text"))


_FIRSTS = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query("agenda_items", "T27", f"SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position, cast(l_linenumber AS VARCHAR) AS number, 'Préavis ' || p || ' relatif au lac' AS title FROM ({_FIRSTS})")
def _(s, d):
    return segment.agenda_items(minutes(s, d), "l_orderkey", "text")


@query("minutes_parts", "G9", f"""
    SELECT id, section_no, component, number, content FROM (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS section_no, 'agenda_item' AS component, cast(l_linenumber AS VARCHAR) AS number, l_linenumber || '. Préavis ' || p || ' relatif au lac' || chr(10) || 'Discussion.' || chr(10) || '9. Rien à voir' AS content FROM ({_FIRSTS}))
    UNION ALL SELECT l_orderkey, 0, 'session_overview', NULL, 'PV' || chr(10) || 'ORDRE DU JOUR' || chr(10) || string_agg(l_linenumber || '. Préavis ' || p || ' rela-' || chr(10) || 'tif au lac', chr(10) ORDER BY l_linenumber) || chr(10) || 'Appel' || chr(10) || 'Le Président ouvre.' FROM ({_FIRSTS}) GROUP BY l_orderkey""")
def _(s, d):
    return segment.minutes_sections(minutes(s, d), "l_orderkey", "text")


@query("sessions_of_minutes", "Z11", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, n FROM orders JOIN (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem GROUP BY 1) ON strftime(o_orderdate, '%Y-%m-%d') = day""")
def _(s, d):
    from civicspark.operators import linkage

    pv = table(s, d, "orders").select("o_orderkey", dates.long_date(cat(lit("Procès-verbal de la séance du "), dates.french_date(F.date_format("o_orderdate", "yyyy-MM-dd")))).alias("day"))
    held = table(s, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return linkage.by_day(pv.where("day >= '1900'"), held, "day")


def regulation(s, d):
    """A regulation for each customer: two titles with a chapter each, three articles."""
    key = c("c_custkey").cast("string")
    return table(s, d, "customer").select("c_custkey", cat(
        lit("Art. 1 But ....... 3\nTITRE I Généralités\nCHAPITRE premier Du Conseil\nArt. 1 – But\nLe conseil "), key, lit(" siège.\nIl délibère.\nArt. 12bis\nTexte\nTITRE II Organes\nSECTION 1 Bureau\nArticle 13. Composition\nLe bureau a "), key, lit(" membres.")
    ).alias("text"))


@query("regulation_articles", "G11 Z42 O8 F4", """
    SELECT c_custkey AS id, 0 AS position, '1' AS article, 'But' AS heading, 'Le conseil ' || c_custkey || ' siège.' || chr(10) || 'Il délibère.' AS content, 'TITRE I Généralités' AS title, 'CHAPITRE premier Du Conseil' AS chapter, NULL AS section FROM customer
    UNION ALL SELECT c_custkey, 1, '12bis', NULL, 'Texte', 'TITRE I Généralités', 'CHAPITRE premier Du Conseil', NULL FROM customer UNION ALL SELECT c_custkey, 2, '13', 'Composition', 'Le bureau a ' || c_custkey || ' membres.', 'TITRE II Organes', NULL, 'SECTION 1 Bureau' FROM customer""")
def _(s, d):
    return segment.regulation_articles(regulation(s, d), "c_custkey", "text").orderBy("id", dates.article_key(c("article")))


@query("articles_in_order", "F4 O8", "SELECT c_custkey AS id, ['1', '12bis', '13'] AS articles, 'Texte' AS content_12bis FROM customer")
def _(s, d):
    rows = segment.regulation_articles(regulation(s, d), "c_custkey", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(dates.article_key(c("article")).alias("k"), "article"))), lambda x: x["article"])
    return rows.groupBy("id").agg(ordered.alias("articles"), F.max(F.when(c("article") == "12bis", c("content"))).alias("content_12bis"))


@query("commission_members", "T22", """
    SELECT c_custkey AS id, 'Anne R' || c AS name, 'Mme' AS civility, 'PS' AS party, 'president_rapporteur' AS role, 'present' AS attendance FROM (SELECT c_custkey, chr(CAST(97 + c_custkey % 20 AS INTEGER)) AS c FROM customer)
    UNION ALL SELECT c_custkey, 'Zoé Roch', 'Mme', NULL, 'member', 'excused' FROM customer UNION ALL SELECT c_custkey, 'Luc Favre', 'M.', NULL, 'member', 'present' FROM customer UNION ALL SELECT c_custkey, 'Jean Blanc', 'M.', NULL, 'member', 'absent_unexcused' FROM customer""")
def _(s, d):
    body = cat(lit("Mmes\nAnne R"), F.char(c("c_custkey") % 20 + 97), lit(" (PS), présidente-rapporteuse\n- Zoé Roch, excusée\nM. Luc Favre en remplacement de M. Paul Noir (PLR)\nPaul Noir\nAbsent non excusé Jean Blanc\n12 membres"))
    rows = table(s, d, "customer").select("c_custkey", body.alias("text"))
    return segment.commission_members(rows, "c_custkey", "text").drop("no")


@query("own_interpellations", "G13", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'whole_document' WHEN 1 THEN 'duplicate_of_standalone' WHEN 2 THEN 'appended_interpellation' ELSE 'appended_interpellation_scanned' END AS method,
      CASE doc_id % 4 WHEN 0 THEN 'Réponse à l’interpellation' || chr(10) || chr(10) || 'Interpellation de ' || source || chr(10) || chr(10) || 'Fin' WHEN 2 THEN 'Interpellation de ' || source || chr(10) || chr(10) || 'Fin' ELSE '' END AS text FROM documents""")
def _(s, d):
    kind = c("doc_id") % 4
    pages = F.when(kind == 3, F.array(lit("Réponse à l’interpellation"), lit(""))).otherwise(F.array(lit("Réponse à l’interpellation"), cat(lit("Interpellation de "), c("source")), lit("Fin")))
    own = segment.own_interpellation(pages, kind == 0, F.when(kind == 1, "x"), kind == 3)
    return council(s, d).select("doc_id", own["method"].alias("method"), own["text"].alias("text"))


@query("last_sections", "G12", "SELECT doc_id, 'Point 3 ' || source || chr(10) || 'Débat' AS section FROM documents")
def _(s, d):
    body = cat(lit("Ordre du jour\nPoint 3 lac\nPoint 4\nSéance\nPoint 3 "), c("source"), lit("\nDébat\nPoint 4 suite\nPoint 4"))
    return council(s, d).select("doc_id", segment.last_section(body, r"^Point 3\b", r"^Point 4\b").alias("section"))


@query("page_components", "Z15 S11", "SELECT doc_id, 'decision' AS component, CAST(2 + doc_id % 2 AS INTEGER) AS page FROM documents UNION ALL SELECT doc_id, 'report', 2 FROM documents WHERE doc_id % 2 = 1")
def _(s, d):
    from civicspark.sources import readers

    body = cat(lit("Préavis"), F.when(c("doc_id") % 2 == 1, "\fRapport de la commission").otherwise(""), lit("\fExtrait du procès-verbal "), c("source"))
    # the first page holds the title alone
    pages = cat(lit("Titre\f"), F.array_join(readers.page_range(readers.pages(body), 2, 9), "\f"))
    found = segment.page_components(pages, [("report", "rapport de la commission"), ("decision", "extrait du proces-verbal")])
    return council(s, d).select("doc_id", F.explode(found).alias("component", "page"))


@query("embedding_recipes", "G14 G15", """
    WITH m AS (SELECT document_id, max(document_family) AS f, max(title) AS t, max(commune) AS co, max(category) AS ca, max(document_date) AS dt FROM document_metadata GROUP BY document_id)
    SELECT c.chunk_id, concat_ws(chr(10) || chr(10), nullif(CASE WHEN m.f = 'political_object' THEN concat_ws(chr(10), 'Type : ' || nullif(m.ca, ''), 'Titre : ' || nullif(m.t, ''), 'Commune : ' || nullif(m.co, ''), 'Date : ' || nullif(m.dt, ''), 'Composant : ' || nullif(c.k, '')) END, ''), c.content) AS input
    FROM (SELECT DISTINCT chunk_id, document_id, CASE WHEN component IN ('postulat_text', 'postulate_text') THEN 'postulate_text' WHEN component IN ('response', 'municipal_response') THEN 'municipal_response' ELSE component END AS k, content FROM chunks) c JOIN m USING (document_id) WHERE m.f IN ('political_object', 'other')""")
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("document_family", "title", "commune", "category", "document_date")])
    rows = chunks(s, d).select("chunk_id", "document_id", segment.canonical_component(c("component")).alias("component"), "section_title", "content", "chunk_index").distinct().join(once.where("document_family in ('political_object', 'other')"), "document_id")
    fields = {"category": c("category"), "title": c("title"), "commune": c("commune"), "date": c("document_date"), "component": c("component"), "section": c("section_title"), "number": c("chunk_index").cast("string"), "year": F.left("document_date", lit(4)), "authors": lit("")}
    return rows.select("chunk_id", segment.embedding_text(c("document_family"), fields, c("content")).alias("input"))


@query("recipes_by_family", "G14", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Préavis municipal : T' || chr(10) || 'Commune : ' || source || chr(10) || 'Partie : annexe' WHEN 1 THEN 'Procès-verbal : T' || chr(10) || 'Séance du 2020' || chr(10) || 'Point 7 : Débat' WHEN 2 THEN 'Rapport annuel : T' || chr(10) || 'Exercice : 2019' || chr(10) || 'Partie : annexe' || chr(10) || 'Section : Débat'
      ELSE 'Règlement : T' || chr(10) || 'Débat' || chr(10) || 'Article 7' END || chr(10) || chr(10) || 'corps' AS input FROM documents""")
def _(s, d):
    family = F.element_at(F.array(*[lit(x) for x in ("preavis", "minutes", "annual", "regulation")]), (c("doc_id") % 4 + 1).cast("int"))
    only = F.when(family != "preavis", "Débat")
    fields = {"title": lit("T"), "commune": c("source"), "date": F.when(family == "minutes", "2020"), "component": lit("annexe"), "section": only, "number": lit("7"), "year": lit("2019"), "category": lit(""), "authors": lit("")}
    return council(s, d).select("doc_id", segment.embedding_text(family, fields, lit("corps")).alias("input"))


@query("object_sheets", "Z20 Z21", """
    SELECT doc_id, concat_ws(chr(10), 'Source : ' || source, 'Catégorie : ' || category, 'Date : ' || document_date) AS sheet, coalesce(document_date || chr(10), '') || 'Réponse' || chr(10) || chr(10) || 'Suite' AS body FROM documents""")
def _(s, d):
    sheet = segment.object_sheet([("Source", c("source")), ("Catégorie", c("category")), ("Auteurs", lit(" ")), ("Date", c("document_date"))])
    event = lambda day, t: F.struct(day.alias("day"), lit(t).alias("text"))
    body = segment.events_body(F.array(event(c("document_date"), " Réponse"), event(lit("x"), "  "), event(lit(None).cast("string"), "Suite")))
    return council(s, d).select("doc_id", sheet.alias("sheet"), body.alias("body"))
