"""Queries on council records: the texts are composed from table rows, read by the operators, and held against the rows.

The composed texts hold the wordings that the operators read, so SQL on the
columns they were composed from gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.catalog import c, docs, query
from civicspark.functions import dates, records, text
from civicspark.operators import browse
from civicspark.sources.tables import table

lit, cat = F.lit, F.concat


def council(s, d):
    """Documents with their date written out, and another number."""
    return table(s, d, "documents").select("doc_id", "source", "category", "commune_key", "document_date", dates.french_date(c("document_date")).alias("written"), (c("doc_id") % 9 + 1).cast("string").alias("no"))


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), text.chf(F.round(c("o_totalprice"), 2)).alias("shown"))


@query("letter_dates", "D4", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND commune_key IN (SELECT commune_key FROM municipalities) THEN document_date END AS letter_date FROM documents")
def _(s, d):
    towns = [r[0] for r in table(s, d, "municipalities").select("commune_key").toLocalIterator()]
    letter = cat(lit("Au Conseil communal\n\n"), F.initcap("commune_key"), lit(", le "), c("written"), lit("\nMonsieur le Président,\nle 3 mai 2011 ..."))
    return council(s, d).select("doc_id", records.letter_date(letter, F.when(c("doc_id") % 3 == 0, "municipal_response").otherwise("motion_text"), towns).alias("letter_date"))


@query("response_dates", "D5 D6 Z23", """
    SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN document_date END, CASE WHEN doc_id % 2 = 0 THEN document_date END, '2019-01-02') AS official,
      left(coalesce(CASE WHEN doc_id % 3 = 0 THEN document_date END, CASE WHEN doc_id % 2 = 0 THEN document_date END, '2019-01-02'), 4) AS year,
      CASE WHEN document_date IS NOT NULL THEN left(document_date, 4) WHEN doc_id % 5 = 0 THEN '2017' ELSE '2021' END AS fallback_year FROM documents""")
def _(s, d):
    official = dates.official_date(F.when(c("doc_id") % 3 == 0, c("document_date")), F.when(c("doc_id") % 2 == 0, c("document_date")), lit("2019-01-02"))
    none = lit(None).cast("string")
    fallback = records.response_year(lit(""), c("document_date"), none, F.when(c("doc_id") % 5 == 0, "2017").otherwise("17"), lit("RI 4/2021 et 2021"))
    return council(s, d).select("doc_id", official.alias("official"), records.response_year(official, none, none, none, none).alias("year"), fallback.alias("fallback_year"))


@query("political_dates", "D3 D7 D8", """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND document_date IS NOT NULL THEN document_date WHEN doc_id % 3 = 0 THEN '2018-02-03' ELSE coalesce(document_date, '2016-01-01') END AS stored,
      CASE WHEN document_date IS NOT NULL THEN document_date WHEN doc_id % 3 = 0 THEN '2018-02-03' ELSE '2016-01-01' END AS shown,
      left(CASE WHEN document_date IS NOT NULL THEN document_date WHEN doc_id % 3 = 0 THEN '2018-02-03' ELSE '2016-01-01' END, 4) AS filed FROM documents""")
def _(s, d):
    name = F.when(c("doc_id") % 4 == 0, cat(lit("objet_12_"), c("document_date"), lit("_texte.pdf"))).otherwise(lit("120212-01-019.pdf"))
    args = name, F.when(c("doc_id") % 3 == 0, "2018-02-03").otherwise(""), lit(None).cast("string"), c("document_date"), lit("2016-01-01")
    return council(s, d).select("doc_id", records.stored_date(*args).alias("stored"), records.shown_date(*args).alias("shown"), records.filing_year(records.shown_date(*args), lit("2010")).alias("filed"))


@query("inferred_years", "D9 Z46", """
    SELECT DISTINCT document_id, coalesce(left(document_date, 4), cast(listing_year AS VARCHAR)) AS document_year, coalesce(nullif(regexp_extract(file_url, '/(20\\d{2})/', 1), ''), cast(listing_year AS VARCHAR)) AS storage_year,
      coalesce(cast(listing_year AS VARCHAR), left(document_date, 4)) AS object_year, regexp_extract(document_id, '_(\\d{4})\\d*_', 1) AS digits FROM document_metadata""")
def _(s, d):
    listed = c("listing_year").cast("string")
    return docs(s, d).select(
        "document_id", records.first_known_year(lit(None).cast("string"), c("document_date"), listed).alias("document_year"), F.coalesce(dates.url_year(c("file_url")), listed).alias("storage_year"),
        records.first_known_year(records.id_year(cat(lit("x-19"), c("category"))), listed, c("document_date")).alias("object_year"), F.regexp_extract("document_id", r"_(\d{4})\d*_", 1).alias("digits"),
    ).distinct()


@query("named_years", "D10", """
    WITH r AS (SELECT DISTINCT document_id, category, left(document_date, 4) AS y, nullif(regexp_extract(file_url, '/(20\\d{2})/', 1), '') AS st FROM document_metadata)
    SELECT document_id, k, v FROM (
      SELECT document_id, 'object_year' AS k, CASE WHEN category IN ('motion','postulat','interpellation') THEN y END AS v FROM r
      UNION ALL SELECT document_id, 'session_year', CASE WHEN category IN ('proces_verbal','ordre_du_jour') THEN y END FROM r
      UNION ALL SELECT document_id, 'fiscal_year', CASE WHEN category IN ('budget','rapport_comptes','rapport_gestion') THEN y END FROM r
      UNION ALL SELECT document_id, 'publication_year', CASE WHEN category NOT IN ('motion','postulat','interpellation','proces_verbal','ordre_du_jour') THEN y END FROM r
      UNION ALL SELECT document_id, 'year_mismatch', CASE WHEN category IN ('motion','postulat','interpellation') AND y <> st THEN 'published_later' END FROM r) WHERE v IS NOT NULL""")
def _(s, d):
    year = F.left("document_date", lit(4))
    rows = docs(s, d).select("document_id", "category", year.alias("y"), dates.url_year(c("file_url")).alias("st")).distinct()
    return rows.select("document_id", F.explode(records.named_years(c("category"), c("y"), c("y"), c("y"), c("y"), c("st"))).alias("k", "v"))


@query("swiss_dates", "D2", "SELECT doc_id, document_date AS day FROM documents")
def _(s, d):
    day = c("document_date")
    return council(s, d).select("doc_id", dates.swiss_date(cat(F.substring(day, 9, 2).cast("int").cast("string"), lit("."), F.substring(day, 6, 2), lit("."), F.left(day, lit(4)))).alias("day"))


@query("names_and_titles", "Z13 Z14 Z45", """
    SELECT doc_id, CASE WHEN document_date IS NOT NULL THEN CAST(doc_id % 9 + 1 AS INTEGER) END AS pv_number, document_date AS pv_day, (doc_id % 9 + 1) || '/2022' AS title_number, document_date AS title_day, document_date AS heading_day FROM documents WHERE document_date IS NOT NULL""")
def _(s, d):
    day = c("document_date")
    rows = council(s, d).where("document_date is not null")
    pv = records.minutes_name(cat(lit("PV_"), c("no"), lit("_"), F.substring(day, 9, 2), lit("-"), F.substring(day, 6, 2), lit("-"), F.substring(day, 3, 2), lit(".pdf")))
    title = records.numbered_title(cat(lit("Préavis N° "), c("no"), lit("/2022 du 1er mars 2001 modifié le "), c("written")))
    head = records.heading_date(cat(lit("Interpellations de M. X du 4 juin 2002 et de Mme Y du "), c("written")))
    return rows.select("doc_id", pv["number"].alias("pv_number"), pv["day"].alias("pv_day"), title["number"].alias("title_number"), title["day"].alias("title_day"), head.alias("heading_day"))


@query("fiscal_periods", "Z43", "SELECT doc_id, left(document_date, 4) AS first_year, cast(cast(left(document_date, 4) AS INTEGER) + doc_id % 2 AS VARCHAR) AS last_year FROM documents WHERE document_date IS NOT NULL")
def _(s, d):
    year = F.left("document_date", lit(4))
    title = cat(lit("Rapport de gestion "), year, F.when(c("doc_id") % 2 == 1, cat(lit("-"), F.substring((year.cast("int") + 1).cast("string"), 3, 2))).otherwise(""))
    period = records.fiscal_period(title)
    return council(s, d).where("document_date is not null").select("doc_id", period["first"].alias("first_year"), period["last"].alias("last_year"))


@query("component_dates", "D14", "SELECT doc_id, document_date AS preavis, '2014-05-06' AS report, CASE WHEN doc_id % 2 = 0 THEN document_date END AS decision FROM documents WHERE document_date IS NOT NULL")
def _(s, d):
    body = cat(lit("Préavis municipal N° 3/2022 du "), c("written"), lit("\nTexte du 4 avril 2003.\nRapport de la commission chargée de l’étude du 6 mai 2014.\n"), F.when(c("doc_id") % 2 == 0, cat(lit("Le Conseil, dans sa séance du "), c("written"), lit(", décide"))).otherwise("Fin"))
    found = records.component_dates(body)
    return council(s, d).where("document_date is not null").select("doc_id", *[found[k].alias(k) for k in ("preavis", "report", "decision")])


@query("response_events", "D13", """
    SELECT doc_id, (doc_id % 9 + 1) || '/2021' AS number, CASE WHEN doc_id % 2 = 0 THEN 'supplemental_response' ELSE 'municipal_response' END AS kind, document_date AS response_date, '2021-07-08' AS adoption_date FROM documents WHERE document_date IS NOT NULL
    UNION ALL SELECT doc_id, (doc_id % 9 + 1) || 'bis/2021', 'municipal_response', '2020-02-29', NULL FROM documents WHERE document_date IS NOT NULL""")
def _(s, d):
    body = cat(
        lit("Interpellation déposée\nRÉPONSE MUNICIPALE N° "), c("no"), lit("/2021\nVérandes, le "), c("written"), lit("\n…\nRÉPONSE MUNICIPALE N° "), c("no"), lit("/2021\n"), F.when(c("doc_id") % 2 == 0, "Complément de réponse").otherwise("Suite"),
        lit(" du 9 mars 2022\nAdopté par la Municipalité : le 8 juillet 2021\nRéponse municipale N° "), c("no"), lit("BIS/2021, le 29 février 2020"),
    )
    return council(s, d).where("document_date is not null").select("doc_id", F.inline(records.response_events(body)))


@query("account_totals", "D16 D17", "SELECT o_orderkey, round(o_totalprice, 2) AS charges, round(o_totalprice, 2) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS result, 1234.5 AS revenues FROM orders")
def _(s, d):
    body = cat(lit("Le total de charges de l’exercice : Fr. "), c("shown"), lit("\net un total de revenus de 1'234.50\nexcédent de "), F.when(c("o_orderstatus") == "F", "charges").otherwise("revenus"), lit(" de Fr. "), c("shown"), lit(" au total"))
    t = records.accounts_totals(body)
    return orders(s, d).select("o_orderkey", t["charges"].alias("charges"), t["result"].alias("result"), t["revenues"].cast("decimal(5,1)").alias("revenues"))


@query("budget_totals", "D16", "SELECT o_orderkey, round(o_totalprice, 2) AS charges, -round(o_totalprice, 2) AS result, CASE WHEN o_orderstatus = 'F' THEN 12000000.0 ELSE 1500.0 END AS investments FROM orders")
def _(s, d):
    spoken = F.when(c("o_orderstatus") == "F", "Les investissements sont planifiés en deux ans, soit un total de Fr. 12 mio").otherwise("| Investissements planifiés en N | 1'500 |")
    t = records.budget_totals(cat(lit("| Poste | Montant |\n| Charges | **"), c("shown"), lit("** |\n| Résultat | -"), c("shown"), lit(" |\n"), spoken))
    return orders(s, d).select("o_orderkey", *[t[k].alias(k) for k in ("charges", "result", "investments")])


@query("observation_numbers", "A22", "SELECT doc_id, CAST(doc_id % 9 + 1 AS INTEGER) AS observations, CASE WHEN doc_id % 2 = 0 THEN 12 END AS wishes FROM documents")
def _(s, d):
    body = cat(lit("## OBSERVATION N° 1\nune observation N° 99\n**OBSERVATION** N° "), c("no"), F.when(c("doc_id") % 2 == 0, "\nVŒU N° 3\nVOEUX 12").otherwise(""))
    return council(s, d).select("doc_id", records.highest_number(body, "OBSERVATION").alias("observations"), records.highest_number(body, "V[ŒO]UX?|VOEUX?").alias("wishes"))


@query("motion_roles", "T24 Z16", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'motion_text' WHEN '2-HIGH' THEN 'combined_motion_report_decision' WHEN '3-MEDIUM' THEN 'combined_motion_report' WHEN '4-NOT SPECIFIED' THEN 'commission_report' ELSE 'council_decision' END AS role,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'majority_and_minority_reports' WHEN '3-MEDIUM' THEN 'minority_report' WHEN '4-NOT SPECIFIED' THEN 'standard_report' END AS report FROM orders""")
def _(s, d):
    kind = c("o_orderpriority")
    label = F.when(kind == "1-URGENT", "Motion renvoyée directement ; renvoyé directement à la Municipalité, décision").when(kind == "2-HIGH", "Rapport et décision").otherwise("Motion de M. X")
    name = F.when(kind == "4-NOT SPECIFIED", "motion-rapp.pdf").when(kind == "5-LOW", "motion-dec.pdf").otherwise("motion-texte.pdf")
    body = F.when(kind == "2-HIGH", "Nous, les soussignés … Rapport de la commission … Rapport de minorité").when(kind == "3-MEDIUM", "Motion : … rapport de minorité").otherwise("Au Conseil")
    return orders(s, d).select("o_orderkey", records.motion_role(label, name, body).alias("role"), records.report_type(label, name, body).alias("report"))


@query("listing_statuses", "T25 Z22", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'not_supported_by_council' WHEN '2-HIGH' THEN 'referred_directly_to_municipality' WHEN '3-MEDIUM' THEN 'referred_to_municipality' WHEN '4-NOT SPECIFIED' THEN 'report_and_decision_available' ELSE 'unknown' END AS status,
      CASE o_orderstatus WHEN 'F' THEN 'Répondu' WHEN 'O' THEN 'En attente de réponse' ELSE 'Accepté' END AS label FROM orders""")
def _(s, d):
    kind, state = c("o_orderpriority"), c("o_orderstatus")
    listing = F.when(kind == "1-URGENT", "Non soutenu (rapport)").when(kind == "2-HIGH", "Renvoyé directement à la Municipalité").when(kind == "3-MEDIUM", "Renvoyé à la municipalité avec rapport").when(kind == "4-NOT SPECIFIED", "Rapport, décision")
    code = text.status_code(F.when(state == "F", "La Municipalité a répondu").when(state == "O", "En cours").otherwise("Pris en considération"))
    return orders(s, d).select("o_orderkey", records.listing_status(listing).alias("status"), records.label_of(code).alias("label"))


@query("response_names", "Z30 Z48", "SELECT document_id, bool_or(document_role = 'municipal_response') AS is_response FROM document_metadata WHERE document_role IS NOT NULL GROUP BY document_id")
def _(s, d):
    name = cat(F.when(c("document_role") == "municipal_response", "Réponse_").otherwise("Repas_"), F.coalesce("category", lit("x")), lit(".pdf"))
    return docs(s, d).where("document_role is not null").groupBy("document_id").agg(F.bool_or(records.is_response_name(text.basename(cat(lit("https://x.example/a/"), name, lit("?v=1"))))).alias("is_response"))


@query("agenda_objects", "Z17 Z18", """
    SELECT doc_id, CASE WHEN category IN ('interpellation', 'postulat', 'motion', 'preavis') THEN category END AS object_type, (doc_id % 9 + 1) || '/2022' AS number,
      CASE WHEN doc_id % 9 = 6 THEN 'deposited' WHEN category IN ('interpellation', 'postulat', 'motion', 'preavis') THEN 'treated' ELSE 'other' END AS status FROM documents""")
def _(s, d):
    named = c("category").isin("interpellation", "postulat", "motion", "preavis")
    item = cat(F.when(named, F.when(c("category") == "preavis", "Préavis").otherwise(F.initcap("category"))).otherwise("Divers"), lit(" N° "), c("no"), lit("/2022"))
    o = records.agenda_object(item)
    return council(s, d).select("doc_id", o["object_type"].alias("object_type"), o["number"].alias("number"), records.agenda_status(cat(c("no"), lit(".2")), item).alias("status"))


@query("session_facts", "T28 Z12", """
    SELECT doc_id, CAST(40 + doc_id % 9 AS INTEGER) AS present, 85 AS elected, '20:15' AS start_time, '2' || (doc_id % 3) || ':05' AS end_time, 'Salle des Remparts' AS location, doc_id % 2 = 0 AS votes,
      CASE WHEN doc_id % 2 = 0 THEN 'large_majority' ELSE 'rejected' END AS vote FROM documents""")
def _(s, d):
    half = c("doc_id") % 2 == 0
    body = cat(lit("Séance à 20h15\nLieu : Salle  des Remparts\n"), (c("doc_id") % 9 + 40).cast("string"), lit(" personnes présentes sur 85 élus.\n"), F.when(half, "Au vote, l’objet est adopté à une large majorité.").otherwise("L’objet est refusé."), lit("\nLa séance est levée à 2"), (c("doc_id") % 3).cast("string"), lit("h05."))
    a, m = records.attendance(body), records.session_details(body)
    return council(s, d).select("doc_id", a["present"].alias("present"), a["elected"].alias("elected"), *[m[k].alias(k) for k in ("start_time", "end_time", "location", "votes")], records.vote_result(body).alias("vote"))


@query("council_decisions", "T29", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rejected_not_referred' WHEN 1 THEN 'referred_to_municipality' ELSE 'adopted' END AS outcome, document_date AS session_date, 'unanimous' AS vote,
      CASE WHEN doc_id % 3 = 0 THEN 'reject_motion' ELSE 'support_motion' END AS recommendation, CASE WHEN doc_id % 2 = 0 THEN true END AS unanimous FROM documents WHERE document_date IS NOT NULL""")
def _(s, d):
    third = c("doc_id") % 3
    body = cat(
        lit("EXTRAIT du procès-verbal de la séance du Conseil communal de Vérandes du "), c("written"), lit("\nLe Conseil décide de "),
        F.when(third == 0, "rejeter la prise en considération").when(third == 1, "renvoyer à la Municipalité").otherwise("valider, adopté"), lit("\nAdopté à l’unanimité.\nConclusion\nLa commission propose"),
        F.when(c("doc_id") % 2 == 0, ", à l’unanimité,").otherwise(""), F.when(third == 0, " de la rejeter").otherwise(" de prendre en considération"),
    )
    o, r = records.council_decision(body), records.recommendation(body)
    return council(s, d).where("document_date is not null").select("doc_id", *[o[k].alias(k) for k in ("outcome", "session_date", "vote")], *[r[k].alias(k) for k in ("recommendation", "unanimous")])


@query("minutes_adopted", "T28 Z12", "SELECT doc_id, CAST(doc_id % 9 + 1 AS INTEGER) AS number, document_date AS day, 'unanimous' AS vote FROM documents WHERE document_date IS NOT NULL")
def _(s, d):
    body = cat(lit("2. Adoption du procès-verbal N° "), c("no"), lit(" de la séance du "), c("written"), lit("\nLe procès-verbal est adopté à l’unanimité avec remerciements."))
    return council(s, d).where("document_date is not null").select("doc_id", F.inline(records.minutes_adopted(body)))


@query("commission_meetings", "Z44", "SELECT doc_id, document_date AS day, '0' || (doc_id % 9 + 1) || ':30' AS time, 'la Maison de commune' AS place FROM documents WHERE document_date IS NOT NULL")
def _(s, d):
    m = records.commission_meeting(cat(lit("La commission s’est réunie le "), c("written"), lit(" à "), c("no"), lit("h30 à la Maison  de commune.\nElle remercie")))
    return council(s, d).where("document_date is not null").select("doc_id", *[m[k].alias(k) for k in ("day", "time", "place")])


@query("prose_people", "T20 T21", """
    SELECT c_custkey, 'Anne Du Pré' || chr(CAST(97 + c_custkey % 20 AS INTEGER)) AS name, 'Mme' AS civility, CASE WHEN c_custkey % 2 = 0 THEN 'PS' END AS party FROM customer
    UNION ALL SELECT c_custkey, 'Luc Favre', 'M.', 'PLR' FROM customer""")
def _(s, d):
    name = cat(lit("Anne Du Pré"), F.char(c("c_custkey") % 20 + 97))
    body = cat(lit("Ont siégé Mme "), name, lit(", M. Luc Favre, Monsieur Seul, M. Luc  Favre (PLR), Madame "), name, F.when(c("c_custkey") % 2 == 0, " (PS), et Mme ").otherwise(", et Mme "), name)
    return table(s, d, "customer").select("c_custkey", F.inline(records.merged_people(records.people(body))))


@query("label_authors", "Z1 Z2 Z3", """
    SELECT c_custkey, 'Luc Favre' AS name, 'M.' AS civility, 'PS' AS party FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'Zoé Roch' || chr(CAST(97 + c_custkey % 20 AS INTEGER)), 'Mme', 'PLR' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'groupe des Verts', NULL, NULL FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 'Zoé Roch' || chr(CAST(97 + c_custkey % 20 AS INTEGER)), 'Mme', NULL FROM customer WHERE c_custkey % 3 = 2""")
def _(s, d):
    third, name = c("c_custkey") % 3, cat(lit("Zoé Roch"), F.char(c("c_custkey") % 20 + 97))
    label = F.when(third == 0, cat(lit("Interpellation de M. Luc Favre (PS) et Mme "), name, lit(" (PLR) : « Le lac »"))).when(third == 1, "Postulat du groupe des Verts « Lac »").otherwise("Le lac")
    body = cat(lit("Au Conseil.\nSignataires : Mme "), name, lit("\n"))
    return table(s, d, "customer").select("c_custkey", F.inline(records.authors_of(lit("interpellation_text"), label, body)))


@query("html_authors", "Z4", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN cast(s_suppkey AS VARCHAR) END AS person_id, s_name AS name, 'rapporteur' AS role FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '7' END, 'Zoé Roch', NULL FROM supplier")
def _(s, d):
    key = c("s_suppkey").cast("string")
    linked = cat(lit('<td><a class="p" href="/fr/person/'), key, lit('/x">'), c("s_name"), lit('</a> (rapporteur), <a href="/fr/person/7">Zoé\n Roch</a></td>'))
    cell = F.when(c("s_suppkey") % 2 == 0, linked).otherwise(cat(lit("<td>"), c("s_name"), lit(" (rapporteur), Zoé Roch</td>")))
    return table(s, d, "supplier").select("s_suppkey", F.inline(records.html_authors(cell)))


@query("object_titles", "Z6", "SELECT DISTINCT document_id, 'Sur ' || listing_year AS heading FROM document_metadata WHERE listing_year IS NOT NULL")
def _(s, d):
    body = F.when(c("listing_year") % 2 == 0, cat(lit("Postulat intitulé : « Sur "), c("listing_year"), lit(" »"))).otherwise(cat(lit("Au Conseil\nObjet :  Sur "), c("listing_year"), lit("\n« autre chose »")))
    return docs(s, d).where("listing_year is not null").select("document_id", records.object_title(body).alias("heading")).distinct()


@query("references", "T18 Z33", "SELECT doc_id, 'RI 0' || (doc_id % 9 + 1) || 'a/2021' AS year_first, 'RI 0' || (doc_id % 9 + 1) || '/2022' AS ri_first, CASE WHEN doc_id % 2 = 0 THEN 'RI 0' || (doc_id % 9 + 1) || '/2023' ELSE 'Réponse municipale n° ' || (doc_id % 9 + 1) || '/2023' END AS bare, 'lettre' AS other FROM documents")
def _(s, d):
    short = c("doc_id") % 2 == 0
    of = lambda x: records.reference(x, short)
    return council(s, d).select("doc_id", of(cat(lit("2021 / ri 00"), c("no"), lit("A"))).alias("year_first"), of(cat(lit("ri "), c("no"), lit("/2022"))).alias("ri_first"), of(cat(lit("0"), c("no"), lit(" / 2023"))).alias("bare"), of(text.first_truthy(lit(None).cast("string"), lit(""), lit("lettre"))).alias("other"))


@query("title_parts", "T17", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Postulat' WHEN 1 THEN 'Interpellation' ELSE 'Motion' END AS label, CASE WHEN doc_id % 3 < 2 THEN 'Mme Roch' ELSE 'A et B' END AS author, CASE doc_id % 3 WHEN 0 THEN 'Lac ' || source || ' (suite)' WHEN 1 THEN 'Lac ' || source ELSE regexp_replace(source, '^motion', '') END AS subject
    FROM (SELECT doc_id, split_part(source, '_', 1) AS source FROM documents)""")
def _(s, d):
    third, name = c("doc_id") % 3, F.split("source", "_")[0]
    title = F.when(third == 0, cat(lit("Postulat de Mme Roch, intitulé « Lac "), name, lit(" » (suite)"))).when(third == 1, cat(lit("Réponse à l’interpellation de Mme Roch ayant pour titre \"Lac "), name, lit('"'))).otherwise(cat(lit("2020_12_"), name, lit(".pdf")))
    p = records.title_parts(lit("motion"), title, text.listed(F.array(lit("A"), lit("B"))))
    return council(s, d).select("doc_id", *[p[k].alias(k) for k in ("label", "author", "subject")])


@query("answer_lines", "T16 T33 T34 Z32", """
    SELECT doc_id, '- **Motion** de A, B et C « ' || source || ' »' || CASE WHEN document_date IS NULL THEN ' – RI 01/2020' ELSE ' – RI 01/2020, ' || (CASE WHEN right(document_date, 2) = '01' THEN '1er' ELSE cast(cast(right(document_date, 2) AS INTEGER) AS VARCHAR) END) || ' ' ||
      ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][cast(substr(document_date, 6, 2) AS INTEGER)] || ' ' || left(document_date, 4) END || CASE WHEN doc_id % 2 = 0 THEN ' – [PDF](https://x.example/' || doc_id || ')' ELSE '' END AS line, format('{:,}', doc_id * 1000) AS amount FROM documents""")
def _(s, d):
    url = F.when(c("doc_id") % 2 == 0, cat(lit("https://x.example/"), c("doc_id"))).otherwise("javascript:x")
    line = records.answer_line(lit("Motion"), text.listed(F.array(lit("A"), lit("B"), lit("C"))), c("source"), c("document_date"), lit("RI 01/2020"), url)
    return council(s, d).select("doc_id", line.alias("line"), F.replace(F.regexp_replace(text.chf(c("doc_id") * 1000), r"\.00$", ""), lit("'"), lit(",")).alias("amount"))


@query("source_links", "T30", "SELECT doc_id, 'Le lac [Source 1](https://x.example/' || doc_id || ') et Source 3.' || chr(10) || 'Fin' AS answer FROM documents")
def _(s, d):
    answer = lit("Le lac Source 1 et Source 3.\n* (Source 2)\n_Sources : 1, 2 et 3_\nFin")
    return council(s, d).select("doc_id", records.source_links(answer, F.array(cat(lit("https://x.example/"), c("doc_id")), lit("https://y.example"))).alias("answer"))


@query("escaped_urls", "T13 T32", "SELECT DISTINCT pdf_url, '&lt;a&gt; &amp; &quot;' || pdf_url || '&quot;' AS escaped, pdf_url AS web, pdf_url AS viewed FROM site_inventory WHERE pdf_url LIKE 'http%' AND NOT regexp_matches(pdf_url, '[&<>\"''%+#?]')")
def _(s, d):
    url = c("pdf_url")
    rows = table(s, d, "site_inventory").where("pdf_url like 'http%'").where(~url.rlike("[&<>\"'%+#?]"))
    viewer = cat(lit("https://x.example/viewer.php?page=2&file="), F.url_encode(url), lit("#zoom"))
    return rows.select("pdf_url", records.html_escaped(cat(lit('<a> & "'), url, lit('"'))).alias("escaped"), text.web_url(url).alias("web"), text.query_value(viewer, "file").alias("viewed")).distinct()


@query("truncated_texts", "T14 T9", "SELECT chunk_id, left(trim(regexp_replace(content, '[\\s\\x{A0}\\x{2007}\\x{202F}]+', ' ', 'g')), 100) AS head, 2 AS markers, 'a b c' AS bare FROM chunks WHERE NOT regexp_matches(content, '[\\x{85}\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}\\x{1c}-\\x{1f}]')")
def _(s, d):
    marked = cat(lit("a 3 | 12 b "), c("chunk_index") % 10, lit("|9 c"))
    rows = table(s, d, "chunks").where(~c("content").rlike(r"[\x85  -  -    　\x1c-\x1f]"))
    return rows.select("chunk_id", text.truncated(c("content"), 100).alias("head"), text.page_markers(marked).alias("markers"), text.without_page_markers(marked).alias("bare"))


#: Words that tell that a question goes on from the ones before (fixed values).
HINTS = "aussi autre autres celle celles celui ceux cela cette meme dernier derniere precedent precedente reponse resume".split()


@query("chat_context", "N9 T35", """
    SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Question de suivi dans une conversation.' || chr(10) || 'Contexte récent:' || chr(10) || 'Utilisateur: ' || trim(regexp_replace(question, '[\\s\\x{A0}]+', ' ', 'g')) || chr(10) || 'Assistant: Voici' || chr(10) || chr(10) || 'Question actuelle: Et celui de ' || item_id || ' ?' ELSE 'Quels projets de la commune concernent la rénovation du lac ?' END AS asked
    FROM eval_items WHERE question IS NOT NULL AND length(question) < 1200""")
def _(s, d):
    history = F.array(F.struct(lit("user").alias("role"), c("question").alias("content")), F.struct(lit("user").alias("role"), lit(" ").alias("content")), F.struct(lit("assistant").alias("role"), lit("Voici\nSources utilisées: a\nb").alias("content")))
    question = F.when(c("item_id") % 2 == 0, cat(lit("Et celui de "), c("item_id"), lit(" ?"))).otherwise("Quels projets de la commune concernent la rénovation du lac ?")
    return table(s, d, "eval_items").where("question is not null and length(question) < 1200").select("item_id", records.in_context(question, history, HINTS).alias("asked"))


@query("salvaged_answers", "X9 Z34", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 2 AS picks, 'a' AS first_id FROM events")
def _(s, d):
    object_ = records.salvaged_json(cat(lit("Voici :\n```json\n"), c("props"), lit("\n``` fin")), "k int")
    ids = records.salvaged_array(lit('Choix : ["a", "b"] merci'), "array<string>")
    return table(s, d, "events").select("event_id", object_["k"].alias("k"), F.size(ids).alias("picks"), F.get(ids, lit(0)).alias("first_id"))


@query("keywords_in_metadata", "F9 F14 X3", """
    SELECT DISTINCT document_id FROM document_metadata WHERE coalesce(document_role, '') NOT IN ('municipal_response','response','status_report','council_decision','consideration_report','commission_report')
    AND (coalesce(title ILIKE '%tilleuls%', false) OR coalesce(commune_key ILIKE '%tilleuls%', false) OR contains('commune_key', 'tilleuls'))
    OR coalesce(document_role, '') NOT IN ('municipal_response','response','status_report','council_decision','consideration_report','commission_report') AND commune_key = 'aubreny'""")
def _(s, d):
    rows = docs(s, d).withColumn("metadata", F.to_json(F.struct("commune_key", "title")))
    hit = text.matches_keywords(["tilleuls"], c("title"), c("metadata")) | text.matches_keywords(['"commune_key":"aubreny"'], c("title"), c("metadata"))
    return rows.where(browse.primary(c("document_role")) & browse.canonical(F.get_json_object("metadata", "$.canonical_object"))).where(hit).select("document_id").distinct()
