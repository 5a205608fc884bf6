"""Segmentation of texts: windows of words, sections between markers, samples of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import compact, fold, normalized_words, word_count


def windows(words: Column, size: int = 450, overlap: int = 60, joiner: str = " ") -> Column:
    """Overlapping windows of an array of words: steps of ``size - overlap``; the last one ends with the words.

    No words give no window, and no window lies within the one before it.
    """
    step = size - overlap
    n = F.size(words)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / F.lit(step))).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), joiner))


def word_windows(text: Column, size: int = 450, overlap: int = 60) -> Column:
    """Windows of words joined by single spaces."""
    return windows(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), size, overlap)


def source_windows(text: Column, size: int = 450, overlap: int = 60) -> Column:
    """Windows that keep the white space of the source between words, trimmed."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))
    return F.transform(windows(pieces, size, overlap, ""), lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", ""))


def short_kept_windows(text: Column, size: int = 450, overlap: int = 60) -> Column:
    """Like ``word_windows``, but a text within ``size`` words stays untouched."""
    return F.when(word_count(text) <= size, F.array(text)).otherwise(word_windows(text, size, overlap))


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s#chunk-%03d", document_id, index)


def chunked(documents: DataFrame, id_col: str, text_col: str, size: int = 450, overlap: int = 60) -> DataFrame:
    """One row for each window: ``document_id``, ``chunk_id``, ``chunk_index``, ``content`` and ``word_count``."""
    # words are cut once a row, not once a window
    words = documents.select(F.col(id_col).cast("string").alias("document_id"), F.filter(F.split(F.col(text_col), r"(?U)\s+"), lambda w: w != "").alias("words"))
    pieces = words.select("document_id", F.posexplode(windows(F.col("words"), size, overlap)).alias("chunk_index", "content"))
    return pieces.select("document_id", chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "content", word_count(F.col("content")).alias("word_count"))


def stripped(text: Column) -> Column:
    """The text without white space, line ends included, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def positions(text: Column, marker: str) -> Column:
    """Where the marker, a literal, stands in the text, counted from 1."""
    lengths = F.transform(F.split(text, rf"\Q{marker}\E", -1), F.length)
    step = len(marker)
    grown = F.aggregate(
        F.slice(lengths, F.lit(1), F.size(lengths) - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, n: F.struct((acc["at"] + n + step).alias("at"), F.array_append(acc["found"], acc["at"] + n).alias("found")),
    )
    return grown["found"]


def spaced(positions: Column, gap: int) -> Column:
    """Positions, in order, that lie more than ``gap`` behind the last one kept."""
    return F.aggregate(
        F.array_sort(positions), F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > gap), F.array_append(acc, x)).otherwise(acc),
    )


def marked_sections(text: Column, pattern: str) -> Column:
    """The text cut before every line that matches ``pattern``; blank sections are left out.

    ``pattern`` applies at the beginning of a line.
    """
    return F.filter(F.transform(F.split(text, f"(?imu)(?=^(?:{pattern}))"), stripped), lambda s: s != "")


RESPONSE_HEADING = r"[^\S\n]*#?\s*R[ÉE]PONSE\s+MUNICIPALE\s+(?:(?:N[°ºO]\s*)?\d+(?:bis)?/\d{4}|ORALE)\b"
#: The heading of an interpellation that is appended to its response (fixed value).
APPENDED = r"[^\S\n]*(?:#\s*)?(?:\*\*)?Interpellation(?:\*\*)?(?:\s+de\s+.+?\s+au\s+Conseil\s+communal\s+du\s+\d{1,2}(?:er)?\s+\w+\s+20\d{2}|\s*:)"
SECTION = "struct<component:string,section_title:string,response_number:string,content:string>"


def merged_preamble(sections: Column, least: int = 60) -> Column:
    """Sections of which a first one under ``least`` words joins the second one if that has the same component."""
    first, second = F.get(sections, F.lit(0)), F.get(sections, F.lit(1))
    merge = (F.size(sections) > 1) & (word_count(first["content"]) < least) & (first["component"] == second["component"])
    joined = F.array(second.withField("content", F.concat_ws("\n", first["content"], second["content"])))
    return F.when(merge, F.concat(joined, F.slice(sections, F.lit(3), F.greatest(F.size(sections) - 2, F.lit(0))))).otherwise(sections)


def response_sections(text: Column, role: Column | None = None) -> Column:
    """Question and municipal responses of a document: structs of component, section_title, response_number and content.

    Numbered and oral responses begin sections; where there are none, a line
    that says that the Municipality responds does.  Without any, the document
    is one section whose component is its role.  A document that begins as a
    response and has its interpellation appended is cut there alone.  A
    preamble under 60 words joins the next section of the same component.
    """
    role = F.coalesce(role, F.lit("")) if role is not None else F.lit("")
    number = lambda s: F.nullif(F.regexp_extract(s, r"(?iu)R[ÉE]PONSE\s+MUNICIPALE\s+N?[°ºO]?\s*(\d+(?:bis)?/\d{4})", 1), F.lit(""))
    heading, answers = f"(?iu)\\A(?:{RESPONSE_HEADING})", r"(?iu)\A[^\n]*La\s+Municipalit[ée]\s+r[ée]pond"
    titled = lambda n, oral: F.when(n.isNotNull(), F.concat(F.lit("Réponse municipale "), n)).when(oral, "Réponse municipale orale").otherwise("Réponse municipale")

    def made(component, title, number_, content) -> Column:
        return F.struct(component.alias("component"), title.alias("section_title"), number_.alias("response_number"), content.alias("content"))

    none = F.lit(None).cast("string")
    cut_at = F.split(text, f"(?imu)(?=^{APPENDED})", 2)
    before, after = stripped(F.get(cut_at, F.lit(0))), stripped(F.get(cut_at, F.lit(1)))
    appended = (F.size(cut_at) > 1) & F.left(text, F.lit(1200)).rlike(r"(?iu)r[ée]ponse\s+[àa]\s+l[’']interpellation")
    as_appended = F.array(
        made(F.lit("municipal_response"), titled(number(before), F.lit(False)), number(before), before), made(F.lit("interpellation_text"), F.lit("Interpellation annexée"), none, after)
    )
    numbered = text.rlike(f"(?imu)^(?:{RESPONSE_HEADING})")
    parts = F.when(numbered, marked_sections(text, RESPONSE_HEADING)).otherwise(F.filter(F.transform(F.split(text, r"(?imu)(?=^[^\n]*La\s+Municipalit[ée]\s+r[ée]pond)", 2), stripped), lambda s: s != ""))
    headed = lambda s: F.when(numbered, s.rlike(heading)).otherwise(s.rlike(answers))
    any_heading = F.exists(parts, headed)
    whole = F.when(role == "interpellation_text", "Interpellation").when(role == "municipal_response", "Réponse municipale").otherwise("Document")
    whole_component = F.when(role.isin("interpellation_text", "municipal_response"), role).otherwise("unknown_component")
    head = lambda s: F.left(s, F.lit(60))
    section = lambda s: F.when(headed(s), made(F.lit("municipal_response"), titled(number(head(s)), head(s).rlike(r"(?i)\bORALE\b")), number(head(s)), s)).otherwise(
        made(F.when(any_heading, F.lit("interpellation_text")).otherwise(whole_component), F.when(any_heading, F.lit("Interpellation")).otherwise(whole), none, s)
    )
    return merged_preamble(F.filter(F.when(appended, as_appended).otherwise(F.transform(parts, section)), lambda x: x["content"] != ""))


def headed_parts(text: Column, rules: list[tuple[Column | str, Column | str, str]], gap: int, flags: str = "(?imu)") -> Column:
    """The text cut at headings: structs of ``component``, ``title`` (null before the first heading), ``start`` and ``content``.

    A rule is (component, title, pattern of a line's beginning); of several
    the first one that fits counts.  A heading within ``gap`` characters of the
    last one that counted is part of its section.
    """
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    pieces = F.split(text, flags + "(?=^(?:" + "|".join(f"(?:{p})" for _, _, p in rules) + "))")

    def kind(piece: Column, field: int) -> Column:
        out = None
        for rule in rules:
            fits = piece.rlike(f"{flags}\\A(?:{rule[2]})")
            out = F.when(fits, column(rule[field])) if out is None else out.when(fits, column(rule[field]))
        return out

    empty = F.array().cast("array<struct<component:string,title:string,start:int,content:string>>")

    def grow(acc: Column, piece: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("title"), F.lit(-1_000_000).alias("start"), F.lit("").alias("content"))), acc["parts"]), -1)
        new = F.struct(kind(piece, 0).alias("component"), kind(piece, 1).alias("title"), acc["at"].alias("start"), piece.alias("content"))
        begins = (F.size(acc["parts"]) == 0) | last["component"].isNull() | (acc["at"] - last["start"] > gap)
        longer = F.concat(F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))), F.array(last.withField("content", F.concat(last["content"], piece))))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(begins, F.array_append(acc["parts"], new)).otherwise(longer).alias("parts"))

    done = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("parts")), grow)["parts"]
    return F.filter(F.transform(done, lambda x: x.withField("content", stripped(x["content"]))), lambda x: x["content"] != "")


#: Headings of the parts of motions and postulates (fixed values).
_MAJORITY, _MINORITY = r"\s*rapport\s+de\s+majorit[ée]", r"\s*rapport\s+de\s+minorit[ée]"
_MARKS = r"\s*(?:#\s*)?(?:\*\*)?"
SECTION_TITLES = {"motion_text": "Motion", "postulat_text": "Postulat", "commission_report": "Rapport de commission", "council_decision": "Décision du Conseil communal"}


def _object_sections(text: Column, role: Column, report_type: Column, rules: list, own: str, fallback: Column, before: Column) -> Column:
    """Sections of a motion or postulate; ``fallback`` is the component of a text without headings, ``before`` that of what stands before the first one."""
    role = F.coalesce(role, F.lit(""))
    titles = F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv])
    parts = headed_parts(text, rules, 120)
    any_heading = F.exists(parts, lambda x: x["component"].isNotNull())
    component = lambda x: F.when(x["component"].isNotNull(), x["component"]).when(any_heading, before).otherwise(fallback)
    named = F.transform(parts, lambda x: F.struct(component(x).alias("component"), F.coalesce(x["title"], F.try_element_at(titles, component(x)), F.lit(own)).alias("section_title"), x["content"].alias("content")))
    return merged_preamble(F.filter(named, lambda x: ~x["content"].rlike(r"(?i)\A(?:page\s*)?\d{1,3}\z") | ~any_heading))


def _unqualified(report_type: Column) -> Column:
    return F.when(F.coalesce(report_type, F.lit("")) == "majority_and_minority_reports", "Rapport de majorité").otherwise("Rapport de commission")


def motion_sections(text: Column, role: Column, report_type: Column) -> Column:
    """The parts of a motion's dossier: motion, reports of the commission, decision; structs of component, section_title and content."""
    rules = [
        ("commission_report", "Rapport de majorité", _MAJORITY), ("commission_report", "Rapport de minorité", _MINORITY),
        ("commission_report", _unqualified(report_type), r"\s*(?:rapport\s+de\s+la\s+commission|commission\s+charg[ée]e)"),
        ("council_decision", "Décision du Conseil communal", r"\s*(?:extrait\s+du\s+proc[èe]s-verbal|d[ée]cision\s+du\s+conseil\s+communal)"),
        ("motion_text", "Motion", r"\s*(?:motion\s*:|motionnaires\s*:|nous,?\s+les\s+soussign[ée]s)"),
    ]
    role = F.coalesce(role, F.lit(""))
    plain = role.isin("motion_text", "commission_report", "council_decision")
    fallback = F.when(plain, role).when(role.startswith("combined_"), "combined_motion_document").otherwise("unknown_component")
    before = F.when(role.isin("motion_text", "combined_motion_report", "combined_motion_report_decision"), "motion_text").when(role == "commission_report", role).otherwise("combined_motion_document")
    return _object_sections(text, role, report_type, rules, "Motion", fallback, before)


def postulate_sections(text: Column, role: Column, report_type: Column) -> Column:
    """The parts of a postulate's dossier; a page number before the first heading is no section."""
    rules = [
        ("commission_report", "Rapport de majorité", _MAJORITY), ("commission_report", "Rapport de minorité", _MINORITY),
        ("commission_report", _unqualified(report_type), _MARKS + r"(?:rapport\s+(?:de\s+la\s+commission|relatif\s+[àa]\s+la\s+prise)|commission\s+charg[ée]e)"),
        ("council_decision", "Décision du Conseil communal", _MARKS + r"(?:extrait(?:\s+du\s+proc[èe]s-verbal)?|d[ée]cision\s+du\s+conseil\s+communal)"),
        ("postulat_text", "Postulat", r"\s*(?:#\s*)?postulat(?:\s+de|\s*:|\s*[-–—]|\s*$)"),
    ]
    role = F.coalesce(role, F.lit(""))
    plain = role.isin("postulat_text", "commission_report", "council_decision")
    before = F.when(role.startswith("combined_postulat") | (role == "postulat_text"), "postulat_text").when(role == "commission_report", role).otherwise("unknown_component")
    return _object_sections(text, role, report_type, rules, "Postulat", F.when(plain, role).otherwise("unknown_component"), before)


#: Headings of the parts of preliminary reports and management reports (fixed values).
_HASHES = r"\s*(?:#{1,6}\s*)?"
PREAVIS_PARTS = [
    ("appendix", _HASHES + r"Annexes?\s*:"), ("majority_report", _HASHES + "Rapport de majorit[ée]"), ("minority_report", _HASHES + "Rapport de minorit[ée]"),
    ("commission_report", _HASHES + "Rapport (?:de la commission|de commission)"),
    ("council_decision", _HASHES + r"(?:D[ée]cision(?:\s+du Conseil communal)?|EXTRAIT[\s\S]{0,140}?(?:proc[èe]s-verbal|PV)[\s\S]{0,140}?Conseil communal)"),
]
ANNUAL_PARTS = [
    ("commission_report", _HASHES + r"RAPPORT\s+(?:DE\s+LA\s+)?COMMISSION\s+DE\s+GESTION\b"), ("municipal_response", _HASHES + r"R[ÉE]PONSE(?:S?\s+DE\s+LA)?\s+MUNICIPAL(?:IT[ÉE]|E)\b"),
    ("council_decision", _HASHES + r"EXTRAIT\s+DU\s+PROC[ÈE]S-VERBAL\b"),
]


def annual_sections(text: Column, rules: list[tuple[str, str]] | None = None, whole: str = "annual_management_report", gap: int = 200) -> Column:
    """The parts of an annual report: structs of component and content; what stands before the first heading is ``whole``."""
    parts = headed_parts(text, [(k, k, p) for k, p in rules or ANNUAL_PARTS], gap)
    return F.transform(parts, lambda x: F.struct(F.coalesce(x["component"], F.lit(whole)).alias("component"), x["content"].alias("content")))


def preavis_sections(text: Column, role: Column) -> Column:
    """The parts of a preliminary report: structs of component and content.

    Headings among the first 150 characters are those of a table of contents;
    one within 120 characters of the last that counted, or of the same kind as
    the part it stands in, is no boundary.  A plain preliminary report has
    appendices only, and a decision within an appendix belongs to it.  A
    document with a decision, but no heading for it, is cut at its last spaced
    ``d é c i d e`` if that stands in its last third.
    """
    role = F.coalesce(role, F.lit(""))
    flags = "(?imu)"
    pieces = F.split(text, flags + "(?=^(?:" + "|".join(f"(?:{p})" for _, p in PREAVIS_PARTS) + r"))|(?=^\s*d\s+é\s+c\s+i\s+d\s+e\b)")

    def kind(piece: Column) -> Column:
        out = F.when(piece.rlike(r"(?iu)\A\s*d\s+é\s+c\s+i\s+d\s+e\b"), "spaced")
        for name, p in PREAVIS_PARTS:
            out = out.when(piece.rlike(f"{flags}\\A(?:{p})"), name)
        return out

    empty = F.array().cast("array<struct<component:string,start:int>>")

    def grow(acc: Column, piece: Column) -> Column:
        last, found = F.element_at(acc["parts"], -1), kind(piece)
        counts = (
            found.isNotNull() & (found != "spaced") & (acc["at"] >= 150) & (acc["at"] - last["start"] >= 120) & (last["component"] != found)
            & ((role != "municipal_preavis") | (found == "appendix")) & ~((last["component"] == "appendix") & (found == "council_decision"))
        )
        late = (found == "spaced") & (acc["at"] > F.length(text) * 0.65)
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"), F.when(F.coalesce(counts, F.lit(False)), F.array_append(acc["parts"], F.struct(found.alias("component"), acc["at"].alias("start")))).otherwise(acc["parts"]).alias("parts"),
            F.when(late, acc["at"]).otherwise(acc["late"]).alias("late"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array_append(empty, F.struct(F.lit("municipal_preavis").alias("component"), F.lit(0).alias("start"))).alias("parts"), F.lit(-1).alias("late"))
    done = F.aggregate(pieces, start, grow)
    undecided = role.contains("decision") & ~F.exists(done["parts"], lambda x: x["component"] == "council_decision") & (done["late"] > 0)
    marks = F.when(undecided, F.array_sort(F.array_append(done["parts"], F.struct(F.lit("council_decision").alias("component"), done["late"].alias("start"))), lambda a, b: a["start"] - b["start"])).otherwise(done["parts"])
    end = lambda i: F.coalesce(F.get(marks, i + 1)["start"], F.length(text))
    return F.filter(F.transform(marks, lambda x, i: F.struct(x["component"].alias("component"), stripped(F.substr(text, x["start"] + 1, end(i) - x["start"])).alias("content"))), lambda x: x["content"] != "")


def text_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines of each text: ``id``, ``no`` and ``line`` with single spaces."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("no", "line")).withColumn("line", compact(F.col("line")))


ITEM = r"^(\d+(?:\.\d+)*)\.\s*(.*)$"


def agenda_items(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The numbered items of the agenda in minutes: ``id``, ``position``, ``number`` and ``title``.

    The agenda stands behind ``ORDRE DU JOUR`` and ends at the line ``Appel``,
    or after 15,000 characters.  Lines without a number go on with the item
    before, a word cut by a hyphen is put together.
    """
    block = F.regexp_extract(F.col(text_col), r"(?isu)ORDRE DU JOUR(.{0,15000}?)(?:^\s*Appel\s*$|\z)".replace("(?isu)", "(?ismu)"), 1)
    lines = text_lines(texts.select(F.col(id_col), block.alias("block")).where("block <> ''"), id_col, "block")
    by_line = Window.partitionBy("id").orderBy("no")
    marked = lines.withColumn("number", F.nullif(F.regexp_extract("line", ITEM, 1), F.lit(""))).withColumn("position", F.count("number").over(by_line) - 1).where("position >= 0 and line <> ''")
    text = F.when(F.col("number").isNotNull(), F.regexp_extract("line", ITEM, 2)).otherwise(F.col("line"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda x: x["t"]), lambda t: t != ""), "\n")
    items = marked.groupBy("id", "position").agg(F.first("number", ignorenulls=True).alias("number"), joined.alias("joined"))
    return items.select("id", "position", "number", F.replace(F.replace("joined", F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")).alias("title")).where("title <> ''")


def minutes_sections(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Minutes cut by the items of their agenda: ``id``, ``section_no``, ``component``, ``number`` and ``content``.

    A line behind ``Appel`` begins an item if it has the item's number and it
    and the next four lines hold the first four words of its title.  What
    stands before is the overview; minutes without such lines are one section.
    """
    lines = text_lines(texts, id_col, text_col)
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-zà-ÿ0-9]+", " "), " "), lambda w: w != "")
    agenda = agenda_items(texts, id_col, text_col).groupBy("id", "number").agg(F.first("title").alias("title"))
    by_line = Window.partitionBy("id").orderBy("no")
    appel = F.max(F.when(F.col("line").rlike("(?i)^appel$"), 1).otherwise(0)).over(by_line)
    # the lines that follow, up to the next number or blank line
    follow = [F.coalesce(F.lead("line", k).over(by_line), F.lit("")) for k in range(1, 5)]
    near, open_ = F.regexp_extract("line", ITEM, 2), F.lit(True)
    for f in follow:
        open_ = open_ & (f != "") & ~f.rlike(r"^\d+(?:\.\d+)*\.\s*")
        near = F.when(open_, F.concat_ws(" ", near, f)).otherwise(near)
    marked = lines.select("*", appel.alias("body"), F.nullif(F.regexp_extract("line", ITEM, 1), F.lit("")).alias("number"), near.alias("near"))
    # where there is no line "Appel", items are looked for everywhere
    called = marked.groupBy("id").agg(F.max("body").alias("called"))
    heads = marked.where("number is not null").join(called, "id").where("body = 1 or called = 0").join(agenda, ["id", "number"])
    wanted, held = F.slice(words(F.col("title")), 1, 4), F.slice(words(F.col("near")), 1, 18)
    starts = heads.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, held)) == 0)).select("id", "no", "number")
    again = F.lag("number").over(Window.partitionBy("id").orderBy("no"))
    starts = starts.withColumn("again", again).where("again is null or again <> number").select("id", "no", F.col("number").alias("item"))
    placed = lines.join(starts, ["id", "no"], "left").withColumn("section", F.count("item").over(by_line))
    grouped = placed.groupBy("id", "section").agg(F.max("item").alias("number"), stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")).alias("content"))
    following = F.lead("number").over(Window.partitionBy("id").orderBy("section"))
    sections = F.max("section").over(Window.partitionBy("id"))
    # a heading that only leads to its first sub-item is left out
    kept = grouped.select("*", following.alias("following"), sections.alias("sections")).where("content <> ''")
    kept = kept.where(F.col("number").isNull() | F.col("following").isNull() | ~F.startswith("following", F.concat("number", F.lit("."))) | (word_count(F.col("content")) >= 20))
    component = F.when(F.col("number").isNotNull(), "agenda_item").when(F.col("sections") > 0, "session_overview").otherwise("meeting_minutes")
    return kept.select("id", F.col("section").alias("section_no"), component.alias("component"), "number", "content")


ARTICLE = r"^Art(?:icle)?\.?\s*(\d+\s*(?:bis|ter|quater)?)\b[\s.:–-]*(.*)$"


def regulation_articles(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The articles of a regulation: ``id``, ``position``, ``article``, ``heading``, ``content``, and the ``title``, ``chapter`` and ``section`` they stand in.

    A new title ends the chapter and the section before, a new chapter the
    section.  Lines up to the next article or heading are its content; the
    table of contents, whose lines end with a page number behind dots, is left
    out.
    """
    lines = text_lines(texts, id_col, text_col).where(~F.col("line").rlike(r"\.{3,}\s*\d+$") & (F.col("line") != ""))
    by_line = Window.partitionBy("id").orderBy("no")
    level = lambda p: F.nullif(F.regexp_extract("line", rf"(?iu)^({p}\s+(?:[IVXLC]+|\d+|premi(?:er|ère))\b.*)$", 1), F.lit(""))
    marked = lines.select("*", level("TITRE").alias("t"), level("CHAPITRE").alias("c"), level("SECTION").alias("s"), F.nullif(F.regexp_extract("line", f"(?i){ARTICLE}", 1), F.lit("")).alias("a"))
    titled = marked.withColumn("title_no", F.count("t").over(by_line)).withColumn("chapter_no", F.count(F.coalesce("t", "c")).over(by_line))
    within = lambda *keys: Window.partitionBy("id", *keys).orderBy("no")
    state = titled.select(
        "id", "no", "line", "a", F.last("t", ignorenulls=True).over(by_line).alias("title"), F.last("c", ignorenulls=True).over(within("title_no")).alias("chapter"),
        F.last("s", ignorenulls=True).over(within("title_no", "chapter_no")).alias("section"), F.coalesce("t", "c", "s").isNotNull().alias("is_heading"),
    ).withColumn("block", F.count(F.when(F.col("is_heading"), 1).when(F.col("a").isNotNull(), 1)).over(by_line))
    # a block begins with a heading or an article
    blocks = state.groupBy("id", "block").agg(
        F.first("a", ignorenulls=True).alias("a"), F.max("is_heading").alias("h"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("ls"), F.max_by(F.struct("title", "chapter", "section"), "no").alias("place")
    ).where("a is not null and not h")
    first = F.get("ls", F.lit(0))["line"]
    position = F.row_number().over(Window.partitionBy("id").orderBy("block")) - 1
    return blocks.select(
        "id", position.alias("position"), F.lower(F.replace("a", F.lit(" "), F.lit(""))).alias("article"), F.nullif(F.regexp_extract(first, f"(?i){ARTICLE}", 2), F.lit("")).alias("heading"),
        F.array_join(F.transform(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: x["line"]), "\n").alias("content"), "place.*",
    )


def commission_members(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The members of a commission listed line by line: ``id``, ``no``, ``name``, ``civility``, ``party``, ``role`` and ``attendance``.

    A civility on a line of its own holds for the lines below; one who is
    replaced by another member doesn't count.
    """
    text = F.col("line")
    absent = F.regexp_extract(text, r"(?iu)^(Absent(?:e)?(?:\s+non\s+excus[ée]e?)?|Excus[ée]e?)\s+", 1)
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s•,-]+", ""), r"(?iu)^(?:Absent(?:e)?(?:\s+non\s+excus[ée]e?)?|Excus[ée]e?)\s+", "")
    given = F.regexp_extract(bare, r"^(Mmes?|Mesdames|Madame|MM?\.|M|Messieurs|Monsieur)\.?(?:\s|$)", 1)
    civility = F.when(given.isin("Mme", "Mmes", "Madame", "Mesdames"), "Mme").when(given != "", "M.")
    rest = F.regexp_replace(bare, r"^(?:Mmes?|Mesdames|Madame|MM?\.|M|Messieurs|Monsieur)\.?(?:\s+|$)", "")
    own = F.split(rest, r"(?i)\s+en\s+remplacement\s+de\s+")
    head = F.get(own, F.lit(0))
    name = compact(F.regexp_replace(F.regexp_replace(head, r"\s*\([^)]*\)", ""), r"(?iu)\s*[,–—-]\s*(?:excusée?|président(?:e)?(?:-rapporteu(?:r|se))?|rapporteu(?:r|se)).*$", ""))
    folded = fold(text)
    role = F.when(folded.rlike("president[e]?-rapporteu"), "president_rapporteur").when(folded.contains("rapporteu"), "rapporteur").when(folded.contains("president"), "president").otherwise("member")
    attendance = F.when(folded.contains("absent non excuse") | folded.contains("absente non excuse"), "absent_unexcused").when(fold(absent).startswith("absent"), "absent").when(folded.contains("excuse"), "excused").otherwise("present")
    party = F.nullif(F.regexp_extract(head, r"\(([A-Z0-9/+.-]{2,})\)", 1), F.lit(""))
    replaced = F.nullif(compact(F.regexp_replace(F.regexp_replace(F.get(own, F.lit(1)), r"\s*\([^)]*\).*$", ""), r"^(?:Mme|M\.|Madame|Monsieur)\s+", "")), F.lit(""))
    lines = text_lines(texts, id_col, text_col).where("line <> ''").select("id", "no", civility.alias("c"), name.alias("name"), party.alias("party"), role.alias("role"), attendance.alias("attendance"), replaced.alias("replaced"))
    carried = F.last("c", ignorenulls=True).over(Window.partitionBy("id").orderBy("no"))
    named = lines.withColumn("civility", carried).where((F.size(F.split("name", " ")).between(2, 6)) & F.col("name").rlike(r"^\p{Lu}[\p{L}'’ -]+$"))
    gone = named.where("replaced is not null").select("id", fold(F.col("replaced")).alias("key")).distinct()
    return named.withColumn("key", fold(F.col("name"))).join(gone, ["id", "key"], "left_anti").select("id", "no", "name", "civility", "party", "role", "attendance")


def appended_page(page: Column) -> Column:
    """Whether a page begins an interpellation: the word among its first 220 characters, and no response to one in its head."""
    head = F.left(compact(page), F.lit(500))
    at = F.regexp_instr(head, F.lit(r"(?i)\binterpellation\b"))
    return at.between(1, 220) & ~normalized_words(head).rlike(r"\breponses? (?:a|au|aux) l? ?interpellations?\b")


def own_interpellation(pages: Column, is_object: Column, duplicate_of: Column, empty_pages: Column) -> Column:
    """The text of an interpellation and how it was found: a struct of ``text`` and ``method``.

    An object is taken whole; one that stands alone elsewhere is left out;
    else its pages from the first that begins an interpellation are taken, and
    where there are none, pages without text tell that they were scanned.
    """
    hits = F.filter(F.transform(pages, lambda p, i: F.when(appended_page(p), i + 1)), lambda i: i.isNotNull())
    first = F.get(hits, F.lit(0))
    rest = lambda n: stripped(F.array_join(F.slice(pages, n, F.greatest(F.size(pages), F.lit(1))), "\n\n"))
    made = lambda text, method: F.struct(text.alias("text"), F.lit(method).alias("method"))
    return (
        F.when(is_object, made(F.array_join(pages, "\n\n"), "whole_document")).when(duplicate_of.isNotNull(), made(F.lit(""), "duplicate_of_standalone"))
        .when(first.isNotNull(), made(rest(F.coalesce(first, F.lit(1))), "appended_interpellation")).when(empty_pages, made(F.lit(""), "appended_interpellation_scanned")).otherwise(made(F.lit(""), "not_found"))
    )


def page_components(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first page, from 1, on which each component is found: a map; pages are separated by form feeds."""
    pages = F.split(text, "\f")

    def first(pattern: str) -> Column:
        return F.get(F.filter(F.transform(pages, lambda p, i: F.when(fold(p).rlike(pattern), i + 1)), lambda i: i.isNotNull()), F.lit(0))

    entries = F.array(*[F.struct(F.lit(name).alias("k"), first(pattern).alias("v")) for name, pattern in rules])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def last_section(text: Column, start: str, end: str) -> Column:
    """From the last match of ``start`` to the first match of ``end`` behind it, or to the end; null if ``start`` isn't found."""
    tail = F.element_at(F.split(text, f"(?im)(?={start})"), -1)
    return F.when(text.rlike(f"(?im){start}"), stripped(F.get(F.split(tail, f"(?im)(?={end})"), F.lit(0))))


def representative(chunks: DataFrame, priority: list[str], edge: int = 2, budget: int = 12_000) -> DataFrame:
    """Of each document the first and last ``edge`` chunks and those of the components in ``priority``, within a budget of characters.

    First chunks come first, then priority components, then last chunks; a
    chunk is taken if the characters so far, with it, are within the budget.
    """
    by_doc = Window.partitionBy("document_id")
    head, tail = F.row_number().over(by_doc.orderBy("chunk_index", "chunk_id")), F.row_number().over(by_doc.orderBy(F.desc("chunk_index"), F.desc("chunk_id")))
    ranked = chunks.withColumn("head", head).withColumn("tail", tail)
    group = F.when(F.col("head") <= edge, 0).when(F.col("component").isin(priority), 1).when(F.col("tail") <= edge, 2)
    order = by_doc.orderBy("grp", "chunk_index", "chunk_id")
    chosen = ranked.withColumn("grp", group).where("grp is not null").withColumn("so_far", F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chosen.where(F.col("so_far") <= budget).select("document_id", "chunk_id", "chunk_index", "component", F.col("grp").alias("priority"), "so_far")


#: Labels of the lines before a chunk's content, by family of documents (fixed values).
RECIPES = {
    "political_object": ("Type : {category}", "Titre : {title}", "Commune : {commune}", "Date : {date}", "Auteurs : {authors}", "Composant : {component}"),
    "preavis": ("Préavis municipal : {title}", "Commune : {commune}", "Date : {date}", "Partie : {component}", "Section : {section}"),
    "minutes": ("Procès-verbal : {title}", "Séance du {date}", "Point {number} : {section}"),
    "annual": ("Rapport annuel : {title}", "Exercice : {year}", "Partie : {component}", "Section : {section}"),
    "regulation": ("Règlement : {title}", "{section}", "Article {number}"),
}


def embedding_text(family: Column, fields: dict[str, Column], content: Column) -> Column:
    """The text that is embedded for a chunk: the labelled lines of its family's recipe, then a blank line and the content.

    A line whose field is null or empty is left out; an unknown family has no lines.
    """
    head = None
    for name, recipe in RECIPES.items():
        lines = []
        for line in recipe:
            field = line[line.index("{") + 1 : line.index("}")]
            if field not in fields and line.count("{") == 1:
                continue
            before, value, rest = line[: line.index("{")], F.nullif(fields[field], F.lit("")), line[line.index("}") + 1 :]
            if "{" in rest:
                other = rest[rest.index("{") + 1 : rest.index("}")]
                text = F.concat(F.lit(before), value, F.lit(rest[: rest.index("{")]), F.coalesce(fields[other], F.lit("")))
            else:
                text = F.concat(F.lit(before), value, F.lit(rest))
            lines.append(text)
        case = F.concat_ws("\n", *lines)
        head = F.when(family == name, case) if head is None else head.when(family == name, case)
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), content)


def object_sheet(fields: list[tuple[str, Column]]) -> Column:
    """A record written as a text: a line ``label : value`` for each field that is known."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label} : "), F.nullif(F.trim(value.cast("string")), F.lit(""))) for label, value in fields])


def events_body(events: Column) -> Column:
    """The texts of response events, structs with ``day`` and ``text``, in one body; blank ones are left out."""
    kept = F.filter(events, lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda e: F.concat_ws("\n", e["day"], F.trim(e["text"]))), "\n\n")


def canonical_component(component: Column) -> Column:
    """Spellings of the same component brought together."""
    return F.when(component.isin("postulat_text", "postulate_text"), "postulate_text").when(component.isin("response", "municipal_response"), "municipal_response").otherwise(component)
