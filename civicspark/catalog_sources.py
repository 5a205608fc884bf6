"""Queries on reading, loading, audits and the control of searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicspark.catalog import c, chunks, docs, query
from civicspark.catalog_records import cat, council, lit
from civicspark.functions import text
from civicspark.operators import quality, retrieval, store
from civicspark.plans import question
from civicspark.session import checkpoint_dir
from civicspark.sources import html, providers, readers
from civicspark.sources.tables import table


def shared(s) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(s)}/civicspark-{uuid.uuid4().hex}"


# ---- files ------------------------------------------------------------------------------------------------------


@query("json_files", "S3 S4", "SELECT s_suppkey, s_name || '-b' AS s_name, 1 AS files FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name || '-a', 1 FROM supplier WHERE s_suppkey % 2 = 1")
def _(s, d):
    folder = shared(s)
    rows = table(s, d, "supplier").select("s_suppkey", "s_name")
    rows.withColumn("s_name", cat("s_name", lit("-a"))).coalesce(1).write.json(f"{folder}/a")
    rows.where("s_suppkey % 2 = 0").withColumn("s_name", cat("s_name", lit("-b"))).coalesce(1).write.json(f"{folder}/b")
    # JSON Lines stand for one object a file here; the last file by path wins
    read = s.read.schema("s_suppkey long, s_name string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.col("_metadata.file_path"))
    last = readers.last_file_wins(read, "s_suppkey")
    return last.select("s_suppkey", "s_name", lit(1).alias("files"))


@query("json_documents", "S3 S5 K16", "SELECT count(*) AS municipalities, max(label) AS last_label FROM municipalities")
def _(s, d):
    folder = shared(s)
    whole = table(s, d, "municipalities").agg(F.to_json(F.struct(F.array_sort(F.collect_list("label")).alias("labels"))).alias("value"))
    whole.coalesce(1).write.text(folder)
    read = readers.json_documents(s, folder, "labels array<string>", "part-*")
    one = quality.one_row(read.where("labels is not null"), "file of municipalities")
    return one.select(F.size("labels").cast("long").alias("municipalities"), F.array_max("labels").alias("last_label"))


@query("json_lines", "S6 K16", "SELECT doc_id, source FROM documents")
def _(s, d):
    folder = shared(s)
    # every record is followed by a blank line
    table(s, d, "documents").select(cat(F.to_json(F.struct("doc_id", "source")), lit("\n")).alias("value")).write.text(folder)
    return readers.json_lines(s, folder, "doc_id long, source string")


@query("text_files", "S7 S31", "SELECT count(*) AS files, sum(length(label)) AS chars FROM municipalities WHERE commune_key < 'm'")
def _(s, d):
    folder = shared(s)
    part = F.when(c("commune_key") < "m", "seance").otherwise("autre")
    table(s, d, "municipalities").select("label", part.alias("kind"), "commune_key").repartition(1).write.partitionBy("kind", "commune_key").text(folder)
    found = readers.texts(s, f"{folder}/kind=seance/*")
    named = readers.named_like(s, f"{folder}/kind=seance", "part-*.txt")
    return found.agg(F.count("*").alias("files")).join(named.agg(F.sum(F.length(F.trim(F.replace("text", lit("\n"), lit(""))))).alias("chars")))


@query("page_statistics", "S8 S10 D24", "SELECT doc_id, 3 AS pages, 1 AS empty_pages, length(source) + 4 AS chars, (length(source) + 4) < 200 AS needs_ocr, source AS first_page FROM documents")
def _(s, d):
    pages = readers.pages(cat(c("source"), lit("\n 12 \f \fFin\nPage 3 / 3\n")))
    bare = F.transform(pages, readers.without_trailing_number)
    stats = readers.page_stats(F.transform(pages, lambda p: F.regexp_replace(p, r"(?i)\n\s*(?:Page )?\d+(?: / \d+)?\s*$", "")))
    ocr = stats["chars"] < F.greatest(lit(200), lit(50) * stats["pages"])
    return council(s, d).select("doc_id", stats["pages"].alias("pages"), stats["empty_pages"].alias("empty_pages"), (stats["chars"] + 1).alias("chars"), ocr.alias("needs_ocr"), F.get(bare, lit(0)).alias("first_page"))


@query("attachment_pages", "S12", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' ELSE 'other' END AS kind, CASE p_size % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS pages FROM part")
def _(s, d):
    head = F.when(c("p_size") % 4 == 0, "255044462D312E37").when(c("p_size") % 4 == 1, "89504E470D0A1A0A").when(c("p_size") % 4 == 2, "FFD8FFE000104A46").otherwise("504B0506")
    kind = readers.file_kind(F.unhex(head))
    return table(s, d, "part").select("p_partkey", kind.alias("kind"), F.size(readers.as_pages(kind, lit("a\fb"))).alias("pages"))


# ---- pages of websites ------------------------------------------------------------------------------------------


@query("result_pages", "S13 T12", "SELECT DISTINCT o_custkey, 'Motion ' || o_orderkey AS title, '« A & B »' AS subject, '2022' AS year, 'https://x.example/m/' || o_orderkey || '.pdf' AS url FROM orders WHERE o_orderstatus <> 'P'")
def _(s, d):
    key = c("o_orderkey").cast("string")
    href = F.when(c("o_orderstatus") == "F", cat(lit("/viewer.php?file=https%3A%2F%2Fx.example%2Fm%2F"), key, lit(".pdf&amp;p=1"))).otherwise(cat(lit("https://x.example/m/"), key, lit(".pdf")))
    name = F.when(c("o_orderstatus") == "P", "Postulat ").otherwise("Motion  ")
    row = cat(lit('<a class="x result" href="'), href, lit('"><h3><b>'), name, key, lit('</b></h3><p>&laquo; A &amp; B &raquo;</p><span class="year"> 2022</span></a>'))
    page = table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.flatten(F.array(F.collect_list(row), F.collect_list(row))), "\n").alias("page"))
    return page.select("o_custkey", F.inline(html.result_rows(c("page"), "Motion", F.array(lit("2022")))))


@query("teasers", "S14 S15", "SELECT source, doc_id, document_date AS date, 'M. Favre' AS author, 'RI' AS kind, cast(doc_id AS VARCHAR) AS reference, 'Lac & rive' AS title, 'https://x.example/dl?d=' || doc_id AS url, cast(doc_id AS VARCHAR) AS download_id FROM documents WHERE document_date IS NOT NULL")
def _(s, d):
    day, key = c("document_date"), c("doc_id").cast("string")
    swiss = F.concat_ws(".", F.substring(day, 9, 2), F.substring(day, 6, 2), F.left(day, lit(4)))
    block = cat(
        lit('<div class="row teaser-politique"><div class="col-3">'), swiss, lit(' <br/>M. Favre</div><div class="col-9"><p class="teaser-id"><span>RI</span> <span>'), key,
        lit('</span></p><h4><a href="/page">Lac &amp; rive</a></h4><div><a href="/x">Voir</a><a href="https://x.example/dl?d='), key, lit('">Télécharger PDF</a></div></div></div>'),
    )
    pages = table(s, d, "documents").where("document_date is not null").groupBy("source").agg(F.array_join(F.collect_list(block), "\n<hr>").alias("page"))
    blocks = html.elements(pages, "source", "page", "div", "teaser-politique")
    return blocks.select(c("id").alias("source"), html.teaser(c("source")).alias("t")).select("source", c("t.download_id").cast("long").alias("doc_id"), "t.*")


@query("object_cards", "S16 S17", """
    SELECT l_orderkey || '' AS id, l_linenumber || '' AS object_id, 'Objet ' || p AS title, 'Zoé Roch' AS author, 2 AS events, 2 AS files, 'Texte ' || p AS label FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)""")
def _(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("p"))
    n, p = c("l_linenumber").cast("string"), c("p")
    card = cat(
        lit('<div class="list card"><div><a href="?ID='), n, lit('">Objet <b>'), p, lit("</b></a><small>Auteur : Zoé\n Roch</small></div><ul><li>Dépôt</li><li>Réponse</li></ul><a href=\"/f?download="), p, lit('">Texte '), p,
        lit('</a><div><a href="/g?x=1&download='), p, lit('">Copie</a><a href="/h.pdf">Annexe</a></div></div>'),
    )
    pages = rows.groupBy("l_orderkey").agg(F.array_join(F.collect_list(card), "\n").alias("page"))
    found = html.cards(pages, "l_orderkey", "page")
    return found.select("id", "object_id", "title", "author", F.size("events").alias("events"), F.size("files").alias("files"), F.get("files", lit(0))["label"].alias("label"))


@query("attribute_rows", "S18 S31 Z31 S23 S24", "SELECT s_nationkey, s_suppkey AS id, s_name AS title, (SELECT count(*) FROM supplier t WHERE t.s_nationkey = supplier.s_nationkey) AS advertised, CAST(ceil((SELECT count(*) FROM supplier t WHERE t.s_nationkey = supplier.s_nationkey) / 3.0) AS INTEGER) AS pages, 0 AS incomplete FROM supplier")
def _(s, d):
    rows = table(s, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct(c("s_suppkey").alias("id"), c("s_name").alias("title")))).alias("j"), F.count("*").cast("string").alias("n"))
    page = cat(lit('<p><b>'), c("n"), lit(' résultats</b></p><table data-entities="'), F.replace("j", lit('"'), lit("&quot;")), lit('">'))
    read = rows.select("s_nationkey", html.advertised_count(page).alias("advertised"), F.inline(html.attribute_json(page, "data-entities", "array<struct<id:long,title:string>>")))
    gaps = html.incomplete(read, "s_nationkey", "advertised", "id").agg(F.count("*").cast("int").alias("incomplete"))
    return read.select("s_nationkey", "id", "title", c("advertised").cast("long").alias("advertised"), html.page_count(c("advertised"), 3).alias("pages")).join(F.broadcast(gaps))


@query("council_members", "S20", "SELECT s_nationkey, 'Zoé ' || s_name AS name, 'PLR' AS party FROM supplier")
def _(s, d):
    row = cat(lit("<li class='row'><span>"), c("s_name"), lit("</span> <span><i>Zoé</i></span></li>"))
    page = table(s, d, "supplier").groupBy("s_nationkey").agg(cat(lit('<div class="question a"><div class="title"><i></i>Parti libéral (PLR)</div> <div class="answer"><ul>'), F.array_join(F.collect_list(row), ""), lit("</ul></div></div>")).alias("page"))
    return page.select("s_nationkey", F.explode(html.accordion(c("page"))).alias("q")).select("s_nationkey", F.inline(html.member_rows(c("q.body"), c("q.title"))))


@query("text_and_links", "S21", "SELECT doc_id, source || chr(10) || 'Suite & fin' AS text, '/p/' || doc_id AS url, 'lire' AS label FROM documents")
def _(s, d):
    page = cat(lit("<script>x<y</script><div><p> "), c("source"), lit(' </p>Suite &amp; <b>fin</b><br/></div><a class="k" href="/p/'), c("doc_id"), lit('"> lire</a>'))
    both = html.text_and_links(page)
    return council(s, d).select("doc_id", F.regexp_replace(both["text"], r"\nlire$", "").alias("text"), F.inline(both["links"]))


@query("decodable_objects", "S22", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(s, d):
    junk = cat(lit("while(1); {pas du json} <p>{"), lit('"x": 1} '), c("props"), lit(" fin"))
    return table(s, d, "events").select("event_id", html.decodable_object(junk, "k int", "k")["k"].alias("k"))


@query("fetched_pages", "S26", "SELECT pdf_url AS url, CASE WHEN pdf_url LIKE '%1%' THEN length(pdf_url) END AS chars, pdf_url NOT LIKE '%1%' AS failed FROM (SELECT DISTINCT pdf_url FROM site_inventory WHERE pdf_url IS NOT NULL)")
def _(s, d):
    def fetch(url: str) -> str:
        if "1" not in url:
            raise ConnectionError("503")
        return url

    found = providers.fetched(table(s, d, "site_inventory").where("pdf_url is not null").select(c("pdf_url").alias("url")), fetch)
    return found.select("url", F.length("body").alias("chars"), c("error").isNotNull().alias("failed"))


@query("recognized_pages", "S28", "SELECT p_partkey || '' AS page_hash, CASE WHEN p_size > 25 THEN 'cached' ELSE upper(p_name) END AS text FROM part")
def _(s, d):
    parts = table(s, d, "part").withColumn("page_hash", c("p_partkey").cast("string"))
    cache = parts.where("p_size > 25").select("page_hash", lit("cached").alias("text"))
    return providers.recognized(parts.select("page_hash", c("p_name").cast("binary").alias("content")), cache, lambda b: bytes(b).decode().upper())


@query("embedded_inputs", "I3", "SELECT item_id, 8 AS dimension, 1.0 AS norm FROM eval_items WHERE question IS NOT NULL")
def _(s, d):
    rows = table(s, d, "eval_items").where("question is not null").select("item_id", "question")
    found = providers.embedded(rows, "question", providers.HashEmbedder(8))
    norm = F.aggregate("embedding", lit(0.0), lambda a, x: a + x * x)
    return found.select("item_id", F.size("embedding").alias("dimension"), F.round(norm, 6).alias("norm"))


# ---- loading ----------------------------------------------------------------------------------------------------


@query("status_summaries", "K3", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE 'Répondu' END AS summary FROM customer")
def _(s, d):
    from civicspark.functions import records

    rows = table(s, d, "customer").select("c_custkey", F.when(c("c_custkey") % 3 == 0, "S").when(c("c_custkey") % 3 == 1, " ").alias("summary"), lit("La Municipalité a répondu").alias("status"))
    return store.status_summaries(rows, "status", records.label_of(text.status_code(c("status")))).select("c_custkey", "summary")


@query("guarded_load", "K5", "SELECT count(*) FILTER (WHERE c_nationkey <> 3) AS before, count(*) FILTER (WHERE c_nationkey <> 3) AS after, true AS safe FROM customer")
def _(s, d):
    before = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    after = store.upsert(before, before.where("c_nationkey = 3").withColumn("c_name", lit("neu")), ["c_custkey"])
    return store.unrelated_counts(before, after, c("c_nationkey") == 3)


@query("run_log", "K7 K10 K12", "SELECT 'gut' AS run_id, 'completed' AS status, count(*) AS rows FROM customer UNION ALL SELECT 'schlecht', 'failed', NULL")
def _(s, d):
    runs = store.Runs(store.Table(s, shared(s)))
    runs.run("gut", lambda: table(s, d, "customer"))
    try:
        runs.run("schlecht", lambda: (_ for _ in ()).throw(ValueError("no load")))
    except ValueError:
        pass
    return runs.states()


@query("appended_log", "K10 K12", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    log = store.Table(s, shared(s))
    for _ in range(2):
        log.append(table(s, d, "events").select("event_id", "event_type"))
    return log.read().groupBy("event_type").agg(F.count("*").alias("n"))


@query("table_statistics", "K8 K14", "SELECT count(*) AS rows, 3 AS columns FROM customer")
def _(s, d):
    name, folder = f"civicspark_{uuid.uuid4().hex}", shared(s)
    table(s, d, "customer").select("c_custkey", "c_name").write.parquet(folder)
    for schema in ("c_custkey BIGINT, c_name STRING", "c_custkey BIGINT, c_name STRING, summary STRING"):
        store.ensure_table(s, name, schema, folder)
        store.ensure_table(s, name, schema, folder)
    rows = store.analyzed(s, name).select("rows", lit(len(s.table(name).columns)).alias("columns")).collect()
    s.sql(f"DROP TABLE {name}")
    return s.createDataFrame(rows, "rows long, columns int")


@query("inserted_once", "K11", "SELECT k, bool_or(coalesce(f, false)) AS opted FROM (SELECT c_custkey AS k, c_custkey % 2 = 0 AS f FROM customer UNION ALL SELECT s_suppkey * 20, true FROM supplier) GROUP BY k")
def _(s, d):
    known = table(s, d, "customer").select(c("c_custkey").alias("k"), (c("c_custkey") % 2 == 0).alias("opted"))
    return store.inserted_once(known, table(s, d, "supplier").select((c("s_suppkey") * 20).alias("k"), lit(True).alias("opted")), "k", "opted")


@query("backfill_steps", "K13", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' WHEN row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) <= 100 THEN c_name END AS summary FROM customer")
def _(s, d):
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.when(c("c_custkey") % 2 == 0, "x").alias("summary"))
    for _ in range(2):
        rows = store.backfill_steps(rows, "summary", c("c_name"), "c_custkey", 50)
    return rows.select("c_custkey", "summary")


@query("cascaded_chunks", "K19", "SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM document_metadata WHERE category = 'preavis')")
def _(s, d):
    return store.cascade(chunks(s, d), docs(s, d).where("category = 'preavis'"), "document_id").select("chunk_id")


@query("overlaid", "S29", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey IN (SELECT c_custkey FROM customer) THEN 'manual' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    given = table(s, d, "customer").where("c_custkey % 7 = 0").select(c("c_custkey").alias("o_orderkey"), lit("manual").alias("o_orderstatus"))
    return store.overlay(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), given, "o_orderkey", "o_orderstatus")


@query("cleaned_values", "X8 Z41", "SELECT doc_id, 'a & b' AS title, ['x y', NULL] AS tags, 'm & n' AS note, source FROM documents")
def _(s, d):
    rows = council(s, d).select("doc_id", lit(" a &amp; b ").alias("title"), F.array(lit("x\u0001  y"), lit(None).cast("string")).alias("tags"), F.create_map(lit("k"), F.struct(lit("m &amp; n").alias("t"))).alias("m"), "source")
    return text.cleaned_values(rows).select("doc_id", "title", "tags", c("m")["k"]["t"].alias("note"), "source")


# ---- audits -----------------------------------------------------------------------------------------------------


def page_lines(s, d):
    """A page for each line item: a header, text, contacts and a page number."""
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("document"), c("l_linenumber").alias("page"), c("l_partkey").cast("string").alias("p")).groupBy("document", "page").agg(F.min("p").alias("p"))
    lines = F.array(cat(lit("Commune  de X"), F.when(c("page") > 3, " bis").otherwise("")), lit("| Total | 1 |"), cat(lit("Texte "), c("p")), lit("www.x.example"), lit("![a](b.png)"), cat(lit("- "), c("page").cast("string"), lit(" -")))
    return rows.select("document", "page", F.posexplode(lines).alias("position", "line")).withColumn("lines", lit(6))


_PAGES = "SELECT DISTINCT l_orderkey AS d, l_linenumber AS p FROM lineitem"


@query("removed_blocks", "Q2 Q3 Q4", f"""
    WITH p AS ({_PAGES}), n AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE p <= 3) AS a, count(*) FILTER (WHERE p > 3) AS b FROM p GROUP BY d)
    SELECT d AS document, p AS page, 'repeated_margin' AS reason, CASE WHEN p > 3 THEN 'Commune de X bis' ELSE 'Commune de X' END AS line FROM p JOIN n USING (d) WHERE CASE WHEN p > 3 THEN b ELSE a END >= greatest(3, round_even(n * 0.35, 0))
    UNION ALL SELECT d, p, CASE WHEN n >= greatest(3, round_even(n * 0.35, 0)) THEN 'repeated_margin' ELSE 'boilerplate' END, 'www.x.example' FROM p JOIN n USING (d)
    UNION ALL SELECT d, p, 'ocr_image_marker', '![a](b.png)' FROM p UNION ALL SELECT d, p, 'boilerplate', '- ' || p || ' -' FROM p""")
def _(s, d):
    lines = page_lines(s, d)
    return quality.cleaned_pages(lines, quality.margin_keys(lines), "x.example")[1].drop("position")


@query("margin_thresholds", "Q2", f"""
    WITH p AS ({_PAGES}), n AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE p <= 3) AS a, count(*) FILTER (WHERE p > 3) AS b FROM p GROUP BY d)
    SELECT d AS document, (a >= greatest(3, round_even(n * 0.2, 0)))::INT + (b >= greatest(3, round_even(n * 0.2, 0)))::INT + (n >= greatest(3, round_even(n * 0.2, 0)))::INT * 3 AS fifth, (a >= 2)::INT + (b >= 2)::INT AS allowed FROM n""")
def _(s, d):
    lines = page_lines(s, d)
    fifth = quality.margin_keys(lines, share=0.2, length=(2, 140)).where("not key like 'texte%'").groupBy("document").agg(F.count("*").cast("int").alias("fifth"))
    two = quality.margin_keys(lines, share=None, least=2, length=(4, 140), allowed=c("line").rlike("^Commune")).groupBy("document").agg(F.count("*").cast("int").alias("allowed"))
    zero = lambda x: F.coalesce(x, lit(0)).alias(x)
    return lines.select("document").distinct().join(fifth, "document", "left").join(two, "document", "left").select("document", zero("fifth"), zero("allowed"))


@query("kept_lines", "Q4", f"SELECT d AS document, count(*) * 2 + coalesce((SELECT sum(CASE WHEN (q.p <= 3) THEN (CASE WHEN a >= t THEN 0 ELSE 1 END) ELSE (CASE WHEN b >= t THEN 0 ELSE 1 END) END) FROM ({_PAGES}) q, (SELECT count(*) FILTER (WHERE p <= 3) AS a, count(*) FILTER (WHERE p > 3) AS b, greatest(3, round_even(count(*) * 0.35, 0)) AS t FROM ({_PAGES}) x WHERE x.d = y.d) WHERE q.d = y.d), 0) AS kept FROM ({_PAGES}) y GROUP BY d")
def _(s, d):
    lines = page_lines(s, d)
    return quality.cleaned_pages(lines, quality.margin_keys(lines), "x.example")[0].groupBy("document").agg(F.count("*").alias("kept"))


@query("header_blocks", "Q1 S9 T9", """
    SELECT doc_id AS document, 1 AS page, 'document_title' AS reason FROM documents UNION ALL SELECT doc_id, 1, 'contact_boilerplate' FROM documents UNION ALL SELECT doc_id, n, 'repeated_header_or_footer' FROM documents, (SELECT unnest([2, 3]) AS n) UNION ALL SELECT doc_id, n, 'page_number' FROM documents, (SELECT unnest([2, 3]) AS n)
    UNION ALL SELECT doc_id, 1, 'response_header' FROM documents WHERE doc_id % 2 = 0""")
def _(s, d):
    first = F.array_join(F.array(lit("tel. 021 977 01 11"), lit("L’entretien des lisières au bord du lac"), F.when(c("doc_id") % 2 == 0, "Réponse municipale N° 3/2021").otherwise("Texte"), *[lit("mot")] * 9), "\n")
    other = lambda n: cat(lit("Commune de X\n"), F.array_join(F.array(*[cat(lit(f"{n} Texte "), c("source"))] * 8), "\n"), lit(f"\n{n} / 3"))
    rows = council(s, d).select("doc_id", F.array(first, other(2), other(3)).alias("pages"))
    blocks = readers.positioned(rows, "doc_id", "pages").withColumnRenamed("id", "document")
    titles = rows.select(c("doc_id").alias("document"), lit("L'entretien des lisières au bord du lac").alias("title"))
    return quality.block_reasons(blocks, titles).where("reason is not null").select("document", "page", "reason")


def audited(s, d):
    once = docs(s, d).groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("title", "category", "document_date", "extraction_method", "file_url", "document_role")], F.max(F.size("authors")).alias("n_authors"))
    return once.select(
        "document_id", "title", "category", "document_date", "document_role", lit(None).cast("string").alias("text_error"), (c("extraction_method") == "ocr_required").alias("needs_ocr"), (F.length("document_id") * 20).alias("text_chars"), (F.length("document_id") % 2).alias("empty_pages"),
        F.when(c("n_authors") > 0, "x").alias("author"), lit(1).alias("occurrences"), c("file_url").alias("pdf_url"),
    )


_AUDITED = "(SELECT document_id, max(title) AS title, max(category) AS category, max(document_date) AS dd, max(extraction_method) AS em, max(file_url) AS url, max(len(authors)) AS na FROM document_metadata GROUP BY document_id)"
_FINDINGS = f"""
    SELECT document_id, 'blocker' AS severity, 'missing_title' AS code FROM {_AUDITED} WHERE coalesce(title, '') = '' UNION ALL SELECT document_id, 'blocker', 'missing_document_date' FROM {_AUDITED} WHERE coalesce(dd, '') = ''
    UNION ALL SELECT document_id, 'blocker', 'ocr_required' FROM {_AUDITED} WHERE em = 'ocr_required' UNION ALL SELECT document_id, 'warning', 'very_short_text' FROM {_AUDITED} WHERE coalesce(em, '') <> 'ocr_required' AND length(document_id) * 20 < 500
    UNION ALL SELECT document_id, 'warning', 'empty_pages' FROM {_AUDITED} WHERE length(document_id) % 2 = 1 UNION ALL SELECT document_id, 'warning', 'missing_author' FROM {_AUDITED} WHERE coalesce(na, 0) = 0
    UNION ALL SELECT document_id, 'warning', 'filename_as_title' FROM {_AUDITED} WHERE regexp_matches(title, '(?i)\\.pdf$') UNION ALL SELECT document_id, 'warning', 'non_https_source' FROM {_AUDITED} WHERE NOT regexp_matches(coalesce(url, ''), '^(?i)https://')"""


@query("preindex_findings", "Q10 Q11", _FINDINGS)
def _(s, d):
    return quality.preindex_findings(audited(s, d), ["title", "document_date"])


@query("preindex_status", "Q10", f"SELECT count(*) FILTER (WHERE severity = 'blocker') AS blockers, count(*) FILTER (WHERE severity = 'warning') + 1 AS warnings, 0 AS infos, CASE WHEN count(*) FILTER (WHERE severity = 'blocker') > 0 THEN 'blocked' ELSE 'ready_with_warnings' END AS status FROM ({_FINDINGS})")
def _(s, d):
    failed = table(s, d, "region").select(c("r_regionkey").cast("string").alias("equivalent_id"))
    return quality.preindex_status(quality.preindex_findings(audited(s, d), ["title", "document_date"]), failed)


@query("record_warnings", "Q12", """
    SELECT document_id, concat_ws(',', CASE WHEN coalesce(na, 0) <= 0 THEN 'authors_missing' END, CASE WHEN contains(role, 'report') THEN 'commission_missing_for_report' END, CASE WHEN contains(role, 'decision') THEN 'decision_date_missing,decision_missing_for_decision_document' END, CASE WHEN coalesce(dd, '') = '' THEN 'document_date_missing' END, CASE WHEN em = 'ocr_required' THEN 'ocr_required' END) AS warnings
    FROM (SELECT document_id, max(document_role) AS role, max(document_date) AS dd, max(extraction_method) AS em, max(len(authors)) AS na FROM document_metadata GROUP BY document_id)""")
def _(s, d):
    rows = docs(s, d).groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("document_role", "document_date", "extraction_method")], F.max(F.size("authors")).alias("n"))
    null = lit(None).cast("string")
    authors = F.when(c("n") > 0, F.array(lit("x")))
    return rows.select("document_id", F.array_join(quality.record_warnings(c("document_role"), c("document_date"), authors, null, null, null, c("extraction_method") == "ocr_required"), ",").alias("warnings"))


@query("field_classes", "Q13", "SELECT doc_id, 'source' AS field, CASE WHEN doc_id % 2 = 0 THEN 'duplicate' ELSE 'contradiction' END AS class FROM documents UNION ALL SELECT doc_id, 'category', 'absent' FROM documents UNION ALL SELECT doc_id, 'document_date', CASE WHEN document_date IS NULL THEN 'duplicate' ELSE 'contradiction' END FROM documents")
def _(s, d):
    extra = F.create_map(lit("origin"), F.when(c("doc_id") % 2 == 0, cat(lit(" "), F.upper("source"))).otherwise("x"), lit("day"), lit(None).cast("string"))
    base = {x: c(x) for x in ("source", "category", "document_date")}
    return council(s, d).select("doc_id", F.inline(quality.field_classes(base, extra, {"source": "origin", "category": "kind", "document_date": "day"})))


@query("load_violations", "Q14 J8", """
    WITH i AS (SELECT DISTINCT chunk_id, category FROM chunks JOIN (SELECT document_id, max(category) AS category FROM document_metadata GROUP BY document_id) USING (document_id)), v AS (SELECT DISTINCT chunk_id, embedding FROM chunks WHERE embedding IS NOT NULL)
    SELECT 'only_left' AS rule, count(*) AS rows FROM i ANTI JOIN v USING (chunk_id) HAVING count(*) > 0 UNION ALL SELECT 'only_right', count(*) FROM v ANTI JOIN i USING (chunk_id) HAVING count(*) > 0
    UNION ALL SELECT 'prefix', count(*) FROM i WHERE NOT starts_with(chunk_id, 'a') UNION ALL SELECT 'category', count(*) FROM i WHERE category IS DISTINCT FROM 'motion' UNION ALL SELECT 'dimension', count(*) FROM v WHERE len(embedding) <> 64 HAVING count(*) > 0""")
def _(s, d):
    once = docs(s, d).groupBy("document_id").agg(F.max("category").alias("category"))
    inputs = chunks(s, d).join(once, "document_id").select("chunk_id", "category").distinct()
    return quality.load_violations(inputs, chunks(s, d).where("embedding is not null").select("chunk_id", "embedding").distinct(), 64, "a", "motion")


@query("retrieval_regression", "Q16", "SELECT s_suppkey AS case_id, s_suppkey % 2 = 0 AS expected_found, s_suppkey % 3 > 0 AS forbidden_absent, s_suppkey % 5 > 0 AS one_commune, s_suppkey % 7 > 0 AS https_sources, s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AS passed FROM supplier")
def _(s, d):
    k = c("s_suppkey")
    cases = table(s, d, "supplier").select(k.alias("case_id"), F.array(lit("gut"), lit("auch")).alias("expected"), F.array(lit("bad_")).alias("forbidden"), lit("X").alias("commune"))
    rows = F.array(*[F.struct(lit(i).alias("place"), doc.alias("document_id"), town.alias("commune"), url.alias("url")) for i, (doc, town, url) in enumerate([
        (F.when(k % 2 == 0, "gut").otherwise("neutral"), lit("X"), lit("https://x.example")), (F.when(k % 3 == 0, "bad_1").otherwise("ok"), F.when(k % 5 == 0, "Y").otherwise("X"), F.when(k % 7 == 0, "http://x").otherwise(""))])])
    return quality.regression(table(s, d, "supplier").select(k.alias("case_id"), F.inline(rows)), cases)


@query("evaluation_hits", "Q17", "SELECT item_id, item_id % 3 > 0 AS hit FROM eval_items")
def _(s, d):
    paths = F.array(lit(""), cat(lit("corpus\\doc_"), c("item_id"), lit(".txt")))
    expected = F.when(c("item_id") % 3 == 1, F.array(cat(lit("doc_"), c("item_id"), lit(".json")))).when(c("item_id") % 3 == 2, F.array(cat(lit("data/corpus/doc_"), c("item_id"), lit(".pdf")))).otherwise(F.array(lit("autre")))
    return table(s, d, "eval_items").select("item_id", quality.hits(paths, expected).alias("hit"))


@query("number_conflicts", "Q19", "SELECT l_orderkey, l_linenumber, bool_or(l_partkey % 2 = 0 AND l_partkey % 10 <> l_suppkey % 10) AS conflict FROM lineitem GROUP BY ALL")
def _(s, d):
    conflict = quality.number_conflict(F.when(c("l_partkey") % 2 == 0, c("l_partkey") % 10), c("l_suppkey") % 10)
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(conflict).alias("conflict"))


# ---- control of searches ----------------------------------------------------------------------------------------


def found(s, d, share):
    """Results with a score, each its own document."""
    score = c("o_totalprice") / share
    return table(s, d, "orders").select(c("o_orderkey").cast("string").alias("chunk_id"), c("o_custkey").cast("string").alias("document_id"), score.alias("score"), c("o_orderpriority").alias("commune")).orderBy(F.desc("score"), "chunk_id").limit(200)


@query("retried_search", "V7", "SELECT o_orderkey || '' AS chunk_id FROM orders ORDER BY o_totalprice DESC, cast(o_orderkey AS VARCHAR) LIMIT 200")
def _(s, d):
    # the first search is weak, the broadened one better
    return retrieval.retried(found(s, d, 1e7).withColumn("chunk_id", cat(lit("x"), c("chunk_id"))), found(s, d, 1e6)).select("chunk_id")


@query("balanced_search", "V8", "SELECT chunk_id, commune FROM (SELECT o_orderkey || '' AS chunk_id, o_orderpriority AS commune, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, cast(o_orderkey AS VARCHAR)) AS rn FROM orders) WHERE rn <= 10 ORDER BY rn, commune LIMIT 50")
def _(s, d):
    rows = table(s, d, "orders").select(c("o_orderkey").cast("string").alias("chunk_id"), c("o_totalprice").alias("score"), c("o_orderpriority").alias("commune"))
    return retrieval.balanced(rows, "commune", 50).select("chunk_id", "commune")


@query("evidence", "V9", "SELECT chunk_id, commune FROM (SELECT o_orderkey || '' AS chunk_id, o_orderpriority AS commune, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, cast(o_orderkey AS VARCHAR)) AS rn FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, cast(o_orderkey AS VARCHAR) LIMIT 200)) ORDER BY rn, commune LIMIT 15")
def _(s, d):
    return retrieval.evidence(found(s, d, 1.0)).select("chunk_id", "commune")


@query("stable_orders", "O4 O5", "SELECT doc_id, row_number() OVER (ORDER BY coalesce(commune_key, ''), coalesce(document_date, ''), doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def _(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "documents").withColumn("place", c("doc_id"))
    top = rows.orderBy(*retrieval.stable_order(rows, [c("commune_key"), c("document_date")])).limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(*retrieval.stable_order(top, [c("commune_key"), c("document_date")]))).alias("place"))


@query("ranked_scores", "W5 O5", "SELECT doc_id, rn, round(1 - rn * 1e-6, 6) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rn FROM documents) WHERE rn < 40")
def _(s, d):
    from pyspark.sql import Window

    top = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(40)
    rn = (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).cast("long")
    return top.select("doc_id", rn.alias("rn")).select("doc_id", "rn", F.round(1 - c("rn") * 1e-6, 6).alias("score"))


#: Questions with what they ask for and what speaks against them (fixed values).
QUESTIONS = [
    ("Combien de postulats entre 2023 et 2021 par des femmes ?", "count", None, "postulats", "2021-2023", None, True, None),
    ("Quelles interpellations à Haut-Lac ont reçu une réponse en 2025 ?", "answered", "Haut-Lac", "interpellations", None, None, False, None),
    ("Liste des motions restées sans réponse à Lac", "unanswered", "Lac", "motions", None, None, False, "type_unavailable"),
    ("Que dit l’article 12bis du règlement du Conseil ?", "search", None, "reglement-conseil-communal", None, "12bis", False, None),
    ("Le budget de Vieux-Bourg", "search", "Vieux-Bourg", "budget", None, None, False, "town_unavailable"),
    ("Compare les préavis de 2021 et 2022", "search", None, None, None, None, True, None),
]


@query("question_plans", "N1-N9", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x + "'" for x in row) + ")" for row in QUESTIONS) + ") t(question, route, city, doc_type, years, article, complex, conflict)")
def _(s, d):
    towns = {"Lac": {"enabled": True, "types": ["postulat"], "names": ["Le Lac"]}, "Haut-Lac": {"enabled": True, "types": ["interpellation"], "names": []}, "Vieux-Bourg": {"enabled": False, "types": [], "names": []}}
    names = {n: label for label, t in towns.items() for n in (label, *t["names"])}
    rows = []
    for q, *_ in QUESTIONS:
        spec = question.understand(q, names, {"city": "all"})
        rows.append((q, spec.route, spec.city, spec.doc_type, "-".join(spec.year_range) if spec.year_range else None, spec.article, question.is_complex(q), question.conflict(q, {"city": spec.city or "all"}, towns)))
    return s.createDataFrame(rows, "question string, route string, city string, doc_type string, years string, article string, complex boolean, conflict string")


@query("event_windows", "I1 streaming", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def _(s, d):
    from civicspark.streaming import changes

    return changes.event_windows(table(s, d, "events").where("ts is not null")).select(c("window.start").alias("hour"), "event_type", "n")
