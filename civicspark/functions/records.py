"""Column expressions that read council records: dates by precedence, roles, votes, decisions, persons, references.

Null input gives null unless a docstring says otherwise.  Wordings, codes and
orders of precedence are fixed values of the records that are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions import dates
from civicspark.functions.text import compact, first_truthy, fold, strip_accents

YEAR = r"^20\d{2}"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is found."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


# ---- dates ------------------------------------------------------------------------------------------------------


def letter_date(text: Column, role: Column, towns: Sequence[str], chars: int = 1800) -> Column:
    """The date behind the town at the head of a municipal response's letter; null for other roles."""
    head = compact(F.left(fold(text), F.lit(chars)))
    places = "|".join(rf"\Q{t.lower()}\E" for t in towns if t)
    return F.when(role == "municipal_response", dates.long_date(_found(head, rf"\b(?:{places})\s*,?\s+le\s+({dates.LONG_DATE[2:-2]})")))


def response_year(official: Column, document_date: Column, listing_date: Column, listing_year: Column, number: Column) -> Column:
    """The year of a response: of its official date, else of the response document's date or listing, else within its number."""
    year = lambda c: F.when(c.rlike(YEAR), F.left(c, F.lit(4)))
    listed = F.when(listing_year.rlike(r"^20\d{2}$"), listing_year)
    return F.coalesce(year(official), year(first_truthy(document_date, listing_date)), listed, dates.first_year(number))


def stored_date(title: Column, deposit: Column, interpellation: Column, document: Column, listing: Column) -> Column:
    """The date of a political object as it is looked up: file name, deposit, interpellation, document, listing."""
    return first_truthy(dates.iso_in_name(title), deposit, interpellation, document, listing)


def shown_date(title: Column, deposit: Column, interpellation: Column, document: Column, listing: Column) -> Column:
    """The date of a political object as it is shown: the document's date comes right behind the file name."""
    return first_truthy(dates.iso_in_name(title), document, deposit, interpellation, listing)


def filing_year(political_date: Column, listing_year: Column) -> Column:
    """The year an object was filed in: of its date, else the listing's if it is one."""
    return F.coalesce(F.when(political_date.rlike(YEAR), F.left(political_date, F.lit(4))), F.when(listing_year.rlike(r"^20\d{2}$"), listing_year))


def year_of(value: Column) -> Column:
    """Four leading digits, else the first year that stands alone."""
    text = F.trim(value.cast("string"))
    return F.coalesce(_found(text, r"^(\d{4})"), dates.first_year(text))


def first_known_year(*values: Column) -> Column:
    """The year of the first value that has one."""
    return F.coalesce(*[year_of(v) for v in values])


def id_year(object_id: Column) -> Column:
    """The year between hyphens in an object's id."""
    return _found(object_id, r"-(20\d{2})-")


#: Families of categories by which years are named (fixed values).
POLITICAL, SESSIONS, ANNUAL = ("motion", "postulat", "interpellation"), ("proces_verbal", "ordre_du_jour"), ("budget", "rapport_comptes", "rapport_gestion")


def named_years(category: Column, object_year: Column, session: Column, fiscal: Column, publication: Column, storage: Column) -> Column:
    """The years that a document's family has: a map from ``object_year``, ``session_year``, ``fiscal_year``, ``publication_year`` and ``year_mismatch`` to their values.

    A political object whose year differs from that of its file's folder has a mismatch.
    """
    political, sessions, annual = category.isin(*POLITICAL), category.isin(*SESSIONS), category.isin(*ANNUAL)
    entries = F.array(
        F.struct(F.lit("object_year").alias("k"), F.when(political, object_year).alias("v")),
        F.struct(F.lit("session_year").alias("k"), F.when(sessions, session).alias("v")),
        F.struct(F.lit("fiscal_year").alias("k"), F.when(annual, fiscal).alias("v")),
        F.struct(F.lit("publication_year").alias("k"), F.when(~political & ~sessions, publication).alias("v")),
        F.struct(F.lit("year_mismatch").alias("k"), F.when(political & (object_year != storage), F.lit("published_later")).alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def date_behind(text: Column, cue: str, within: int = 160) -> Column:
    """The first French date within so many characters behind a cue."""
    return dates.long_date(_found(fold(text), rf"(?s){cue}(.{{0,{within}}})"))


def component_dates(text: Column) -> Column:
    """The dates of a dossier's parts: struct of ``preavis``, ``report`` and ``decision``."""
    return F.struct(
        date_behind(text, r"preavis(?: municipal)? n[°o]? ?\S+ du ", 40).alias("preavis"), date_behind(text, r"rapport de la commission[^.]{0,80}? du ", 40).alias("report"),
        date_behind(text, r"dans sa seance du ", 40).alias("decision"),
    )


RESPONSE = r"(?iu)R[ÉE]PONSE\s+MUNICIPALE(?:\s+ORALE)?(?:\s+N[°ºO]\s*(\d+(?:bis)?/\d{4}))?"


def response_events(text: Column) -> Column:
    """The municipal responses in a document: structs of ``number``, ``kind``, ``response_date`` and ``adoption_date``.

    Responses with the same number are one: of each date the first one known
    counts.  One without a number is a response of its own only where none has
    a number; else its adoption date fills the gap of the numbered one before it.
    """
    parts = F.slice(F.split(text, f"(?={RESPONSE})"), F.lit(1), F.lit(1_000_000))
    found = F.filter(parts, lambda p: p.rlike(rf"\A{RESPONSE}"))
    event = lambda p: F.struct(
        F.lower(_found(p, RESPONSE)).alias("number"),
        F.when(F.left(p, F.lit(1200)).rlike(r"(?i)compl[ée]ment\s+de\s+r[ée]ponse"), "supplemental_response").when(F.left(p, F.lit(1200)).rlike(r"(?i)r[ée]ponse\s+municipale\s+orale"), "oral_response").otherwise("municipal_response").alias("kind"),
        dates.long_date(F.left(p, F.lit(700))).alias("response_date"), date_behind(p, r"adopte\s+par\s+la\s+municipalite", 100).alias("adoption_date"),
    )
    events = F.transform(found, event)
    numbers = F.array_distinct(F.filter(F.transform(events, lambda e: e["number"]), lambda n: n.isNotNull()))
    # an event without number goes with the last number before it
    owned = F.transform(events, lambda e, i: F.struct(F.coalesce(e["number"], F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(F.slice(events, F.lit(1), i + 1), lambda x: x["number"]), lambda n: n.isNotNull())), -1)).alias("owner"), e.alias("e")))
    first = lambda own, field: F.get(F.filter(F.transform(own, lambda x: x["e"][field]), lambda v: v.isNotNull()), F.lit(0))

    def merged(number: Column) -> Column:
        own = F.filter(owned, lambda x: x["owner"] == number)
        numbered = F.filter(own, lambda x: x["e"]["number"].isNotNull())
        kind = F.when(F.exists(numbered, lambda x: x["e"]["kind"] == "supplemental_response"), "supplemental_response").otherwise(F.get(numbered, F.lit(0))["e"]["kind"])
        return F.struct(number.alias("number"), kind.alias("kind"), first(numbered, "response_date").alias("response_date"), first(own, "adoption_date").alias("adoption_date"))

    return F.when(F.size(numbers) > 0, F.transform(numbers, merged)).otherwise(events)


def minutes_name(name: Column) -> Column:
    """Number and date in the file name of minutes, as ``PV_03_12-05-22``; two-digit years are of this century."""
    p = r"(?i)pv[_-]?(\d{1,3})[_-](\d{1,2})[.-](\d{1,2})[.-](\d{4}|\d{2})(?!\d)"
    year = F.regexp_extract(name, p, 4)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    day = F.date_format(F.try_to_date(F.concat_ws("-", full, F.lpad(F.regexp_extract(name, p, 3), 2, "0"), F.lpad(F.regexp_extract(name, p, 2), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.struct(F.regexp_extract(name, p, 1).try_cast("int").alias("number"), day.alias("day"))


def numbered_title(title: Column) -> Column:
    """Number and date of a title such as ``Préavis N° 12/2022 du 3 mai 2022``."""
    return F.struct(_found(title, r"(?i)\bN[°ºo]\.?\s*(\d{1,3}(?:[/-](?:20)?\d{2})?)").alias("number"), dates.last_long_date(title).alias("day"))


def heading_date(text: Column, kind: str = "Interpellations?") -> Column:
    """The last date of a heading that begins with a kind of object."""
    return F.when(text.rlike(rf"(?i)^\s*{kind}\b"), dates.last_long_date(_found(text, r"(?is)\bdu\s+(.*)$")))


def fiscal_period(title: Column) -> Column:
    """First and last year of an annual report: ``2021-2022``, ``2021 - 22`` or one year."""
    p = r"\b(20\d{2})\s*[-–/]\s*(20\d{2}|\d{2})\b"
    one, two = dates.first_year(title), _found(title, p, 2)
    return F.struct(one.alias("first"), F.coalesce(F.when(F.length(two) == 2, F.concat(F.left(_found(title, p), F.lit(2)), two)).otherwise(two), one).alias("last"))


# ---- amounts ----------------------------------------------------------------------------------------------------


def amount(text: Column) -> Column:
    """A number with apostrophes between thousands."""
    return F.translate(text, "'’", "").try_cast("double")


def accounts_totals(text: Column) -> Column:
    """Charges, revenues and signed result of an account's summary: an excess of charges is negative."""
    total = lambda what: amount(F.rtrim(_found(text, rf"(?i)total\s+de\s+{what}\s+de[^\r\n]{{0,80}}?([0-9][0-9'.]{{3,}})"), F.lit(".")))
    p = r"(?i)exc[ée]dent\s+de\s+(revenus|charges)\s+de[^\r\n]{0,80}?([0-9][0-9'.]{3,})"
    sign = F.when(F.lower(F.regexp_extract(text, p, 1)) == "charges", -1.0).otherwise(1.0)
    return F.struct(total("charges").alias("charges"), total("revenus").alias("revenues"), (sign * amount(F.rtrim(_found(text, p, 2), F.lit(".")))).alias("result"))


def budget_totals(text: Column) -> Column:
    """The same from the rows of a Markdown table, and the planned investments, which may be given in millions."""
    row = lambda what: amount(_found(text, rf"(?im)^\|\s*{what}\s*\|\s*\**(-?[0-9][0-9'’.]*)"))
    p = r"(?is)investissements\s+(?:sont\s+)?(?:planifi[ée]s|pr[ée]vus).{0,800}?soit\s+un\s+total\s+de\s+Fr\.\s*([0-9][0-9'’.]*)\s*(mio|million)?"
    spoken = amount(_found(text, p)) * F.when(_found(text, p, 2).isNotNull(), 1e6).otherwise(1.0)
    return F.struct(row("Charges").alias("charges"), row("Revenus").alias("revenues"), row("R[ée]sultats?").alias("result"), F.coalesce(row(r"Investissements\s+planifi[ée]s(?:\s+en\s+N)?"), spoken).alias("investments"))


def highest_number(text: Column, label: str) -> Column:
    """The largest number of the lines that begin with a label, as ``OBSERVATION N° 7``."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^\s*(?:#{{1,6}}\s*)?\*{{0,2}}(?:{label})\*{{0,2}}\s*(?:N[°O]\s*)?(\d+)"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.try_cast("int")))


# ---- roles, statuses --------------------------------------------------------------------------------------------


def report_type(label: Column, name: Column, text: Column) -> Column:
    """Which reports a dossier holds; beside a minority report an unqualified one is that of the majority."""
    all_text, file = fold(F.concat_ws(" ", label, name, text)), fold(name)
    minority = all_text.contains("rapport de minorite") | file.contains("rapp-min")
    majority = all_text.contains("rapport de majorite") | file.contains("rapp-maj") | (minority & all_text.contains("rapport de la commission"))
    return F.when(majority & minority, "majority_and_minority_reports").when(majority, "majority_report").when(minority, "minority_report").when(all_text.contains("rapp"), "standard_report")


def motion_role(label: Column, name: Column, text: Column) -> Column:
    """What a motion's document is; a listing that calls it referred or not supported wins over words in its text."""
    listed, file = fold(F.coalesce(label, F.lit(""))), fold(F.coalesce(name, F.lit("")))
    plain = any_of(listed, ["renvoye directement", "non soutenu"]) & ~any_of(file, ["rapp", "dec"])
    hay = fold(F.concat_ws(" ", label, name, F.left(text, F.lit(2500))))
    report, decision = hay.contains("rapport") | file.contains("rapp"), hay.contains("decision") | file.contains("dec")
    own = any_of(hay, ["nous, les soussignes", "proposons la motion suivante", "motion :"])
    return (
        F.when(plain, "motion_text").when(report & decision & own, "combined_motion_report_decision").when(report & own, "combined_motion_report")
        .when(report, "commission_report").when(decision, "council_decision").otherwise("motion_text")
    )


def listing_status(label: Column) -> Column:
    """Code of a motion's status in a listing."""
    t = fold(F.coalesce(label, F.lit("")))
    referred = t.contains("renvoye") & t.contains("municipalite")
    return (
        F.when(t.contains("non soutenu"), "not_supported_by_council").when(referred & t.contains("renvoye directement"), "referred_directly_to_municipality").when(referred, "referred_to_municipality")
        .when(t.contains("rapport") & t.contains("decision"), "report_and_decision_available").when(t.contains("rapport"), "report_available").when(t.contains("decision"), "decision_available").otherwise("unknown")
    )


#: Labels of status codes (fixed values).
STATUS_LABELS = {
    "answered": "Répondu", "pending": "En attente de réponse", "withdrawn": "Retiré", "accepted": "Accepté", "rejected": "Refusé", "other": "Autre",
}


def label_of(code: Column, labels: dict[str, str] = STATUS_LABELS) -> Column:
    """The label of a code; an unknown code is its own label."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code), code)


def is_response_name(name: Column) -> Column:
    """Whether a file's name is that of a response."""
    return F.coalesce(fold(name).rlike(r"(?:^|[^a-z])(?:reponse|rep|ri)(?=[^a-z]|$)"), F.lit(False))


def agenda_object(title: Column) -> Column:
    """Type and number of the object that an agenda item is about."""
    t = fold(title)
    kind = (
        F.when(t.contains("interpellation"), "interpellation").when(t.contains("postulat"), "postulat").when(t.contains("motion"), "motion").when(t.contains("preavis"), "preavis")
        .when(t.rlike("proces-verbal"), "proces_verbal").when(t.contains("communication"), "communication")
    )
    return F.struct(kind.alias("object_type"), _found(t, r"\bn[°o]\.?\s*(\d{1,3}(?:[/-](?:20)?\d{2,4})?)").alias("number"))


def agenda_status(number: Column, title: Column) -> Column:
    """Whether an item deposits an object (heading 7), answers one or treats one."""
    t = fold(title)
    return F.when(number.startswith("7."), "deposited").when(t.contains("reponse"), "answered").when(t.rlike("interpellation|postulat|motion|preavis"), "treated").otherwise("other")


# ---- votes and decisions ----------------------------------------------------------------------------------------


def vote_result(text: Column) -> Column:
    """unanimous, large_majority, majority or rejected."""
    t = fold(text)
    return F.when(t.contains("unanimite"), "unanimous").when(t.contains("large majorite"), "large_majority").when(t.contains("majorite"), "majority").when(t.rlike("refuse|rejete"), "rejected")


def attendance(text: Column) -> Column:
    """How many members are present and how many were elected."""
    p = r"(?i)(\d+)\s+(?:personnes\s+)?present(?:e)?s?\s+sur\s+(\d+)\s+(?:personnes\s+)?(?:membres\s+)?elus?"
    t = strip_accents(text)
    return F.struct(F.regexp_extract(t, p, 1).try_cast("int").alias("present"), F.regexp_extract(t, p, 2).try_cast("int").alias("elected"))


def recommendation(text: Column) -> Column:
    """What a commission recommends, read behind its conclusion or in the last 2500 characters, and whether it was unanimous."""
    section = F.coalesce(_found(text, r"(?is)\bConclusion\s+(.{0,1400})"), F.right(text, F.lit(2500)))
    t = fold(section)
    advice = F.when(any_of(t, ["rejeter", "ne pas la renvoyer"]), "reject_motion").when(any_of(t, ["prendre en consideration", "renvoyer a la municipalite"]), "support_motion")
    return F.struct(advice.alias("recommendation"), F.when(t.rlike(r"\ba l['’]unanimite"), True).alias("unanimous"))


def council_decision(text: Column) -> Column:
    """Outcome, session and vote in an extract from the minutes; nulls where there is no extract."""
    section = _found(text, r"(?is)(EXTRAIT\s+du proc[èe]s-verbal.{0,1800})")
    t = fold(section)
    outcome = F.when(any_of(t, ["rejeter la prise en consideration", "ne pas la renvoyer"]), "rejected_not_referred").when(t.contains("renvoyer a la municipalite"), "referred_to_municipality").when(t.contains("adopte"), "adopted")
    return F.struct(outcome.alias("outcome"), date_behind(section, r"seance du conseil communal.{0,140}?du\s", 80).alias("session_date"), vote_result(_found(section, r"(?i)(Adopt[ée]\s+à\s+[^.\n]+)")).alias("vote"))


def minutes_adopted(text: Column) -> Column:
    """The earlier minutes that were adopted: structs of number, day and vote."""
    p = r"(?is)Adoption du proc[èe]s-verbal\s+N[°o]\s*(\d+).*?s[ée]ance du\s+(\d{1,2}(?:er)?\s+\S+\s+\d{4}).{0,360}?est adopt[ée].{0,160}?(?:\.|$)"
    each = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, p, 1).try_cast("int").alias("number"), dates.long_date(F.regexp_extract(x, p, 2)).alias("day"), vote_result(x).alias("vote")))


def session_details(text: Column) -> Column:
    """Times, place and officers of a session from its minutes."""
    time = lambda t, p: F.when(t.rlike(p), F.concat(F.lpad(F.regexp_extract(t, p, 1), 2, "0"), F.lit(":"), F.regexp_extract(t, p, 2)))
    line = lambda p: compact(_found(text, rf"(?i)(?:{p})\s*:\s*([^\n]{{3,120}})"))
    return F.struct(
        time(text, r"(?i)\b[àa]\s+(\d{1,2})\s*h\s*(\d{2})\b").alias("start_time"), time(F.right(text, F.lit(10_000)), r"(?i)(?:s[ée]ance|session)\s+(?:est\s+)?lev[ée]e?\s+[àa]\s+(\d{1,2})\s*h\s*(\d{2})").alias("end_time"),
        line("Lieu|Salle").alias("location"), line("Pr[ée]sidence").alias("president"), line("Secr[ée]taire").alias("secretary"),
        text.rlike(r"(?i)\b(?:au vote|mise aux voix|par \d+ voix|à l.unanimit[ée]|majorit[ée])\b").alias("votes"),
    )


def commission_meeting(text: Column) -> Column:
    """Day, time and place of a commission's meeting."""
    raw = compact(_found(text, r"(?is)s['’ ]est\s+r[ée]unie\s+(?:le\s+)?(.{0,320}?)(?:\.\s|\.$|Les membres|La commission|\n\n)"))
    hour = r"\b(\d{1,2})h(?:[. ]?(\d{2}))?"
    return F.struct(
        dates.long_date(raw).alias("day"), F.when(raw.rlike(hour), F.concat(F.lpad(F.regexp_extract(raw, hour, 1), 2, "0"), F.lit(":"), F.rpad(F.regexp_extract(raw, hour, 2), 2, "0"))).alias("time"),
        _found(raw, r"\b(?:à|a)\s+(?!\d{1,2}h)([^\d].*)$").alias("place"),
    )


# ---- persons ----------------------------------------------------------------------------------------------------

_PERSON = r"\b(Mme|M\.|Madame|Monsieur)\s+(\p{Lu}[\p{L}'’ -]+?)(?:\s*,?\s*\(([^)]+)\))?(?=\s*(?:,|;|$|\n| et ))"
PERSON = "array<struct<name:string,civility:string,party:string>>"


def people(text: Column) -> Column:
    """The persons with a civility in running text: structs of name, civility and party; names have two words at least."""
    parts = [F.regexp_extract_all(text, F.lit(_PERSON), F.lit(i)) for i in (1, 2, 3)]
    all_ = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("c", "n", "p"))])
    person = lambda x: F.struct(compact(x["n"]).alias("name"), F.when(x["c"].isin("Mme", "Madame"), "Mme").otherwise("M.").alias("civility"), F.nullif(F.trim(x["p"]), F.lit("")).alias("party"))
    return F.array_distinct(F.filter(F.transform(all_, person), lambda x: F.size(F.split(x["name"], " ")) >= 2))


def merged_people(persons: Column) -> Column:
    """Each person once, by folded name, in order; the first party known is kept."""
    names = F.array_distinct(F.transform(persons, lambda x: fold(x["name"])))

    def one(name: Column) -> Column:
        own = F.filter(persons, lambda x: fold(x["name"]) == name)
        return F.get(own, F.lit(0)).withField("party", F.get(F.filter(F.transform(own, lambda x: x["party"]), lambda p: p.isNotNull()), F.lit(0)))

    return F.transform(names, one)


def label_authors(label: Column) -> Column:
    """The authors a listing's label names: behind ``de``, separated by commas and ``et``, a party in brackets at the end holds for all without one; groups keep their name and have no civility."""
    named = F.regexp_replace(_found(label, r"(?is)^\s*(?:interpellation|postulat|motion)\s+(?:de\s+|du\s+|des\s+|d['’])(.*?)(?:\s*[:«\"].*)?$"), r"\s*,\s*et\s+|\s+et\s+", ", ")
    pieces = F.filter(F.transform(F.split(named, r",\s*(?![^()]*\))"), compact), lambda x: x != "")
    shared = _found(F.element_at(F.concat(F.array(F.lit("")), pieces), -1), r"\(([^()]+)\)\s*$")

    def one(x: Column) -> Column:
        civility = F.when(x.rlike(r"^(?:Mmes?|Madame|Mesdames)\b"), "Mme").when(x.rlike(r"^(?:MM?\.|Monsieur|Messieurs)"), "M.")
        group = fold(x).rlike("^(?:groupe|parti|au nom d)")
        name = compact(F.regexp_replace(F.regexp_replace(x, r"\s*\([^()]*\)", ""), r"^(?:Mmes?|Madame|Mesdames|MM?\.|Monsieur|Messieurs)\s+", ""))
        party = F.when(~group, F.coalesce(_found(x, r"\(([^()]+)\)"), shared))
        return F.struct(name.alias("name"), F.when(~group, civility).alias("civility"), party.alias("party"))

    return F.filter(F.transform(pieces, one), lambda x: x["name"] != "")


def authors_of(kind: Column, label: Column, text: Column) -> Column:
    """Authors by type of document: of the label where it names some, else the persons of the text's signature, else those of its beginning; responses have none."""
    none = F.array().cast(PERSON)
    of_label, signed, begun = label_authors(label), people(_found(text, r"(?is)(?:Signataires?|Auteurs?|Signé)\s*:\s*(.{0,600})")), people(F.left(text, F.lit(600)))
    pick = F.when(F.size(F.coalesce(of_label, none)) > 0, of_label).when(F.size(F.coalesce(signed, none)) > 0, signed).otherwise(begun)
    return F.when(kind == "municipal_response", none).otherwise(merged_people(pick))


def html_authors(html: Column) -> Column:
    """Authors in a page's cell: linked persons with their ids, else plain text cut at commas; a role stands in brackets."""
    p = r"(?is)<a[^>]*href=\"[^\"]*?/person/(\d+)[^\"]*\"[^>]*>\s*(.*?)\s*</a>(?:\s*\(([^()<]+)\))?"
    ids, names, roles = (F.regexp_extract_all(html, F.lit(p), F.lit(i)) for i in (1, 2, 3))
    linked = F.transform(F.arrays_zip(ids.alias("i"), names.alias("n"), roles.alias("r")), lambda x: F.struct(x["i"].alias("person_id"), compact(x["n"]).alias("name"), F.nullif(x["r"], F.lit("")).alias("role")))
    text = F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]+>", " "), ","), compact), lambda x: x != "")
    bare = F.transform(text, lambda x: F.struct(F.lit(None).cast("string").alias("person_id"), compact(F.regexp_replace(x, r"\([^()]*\)", "")).alias("name"), _found(x, r"\(([^()]+)\)").alias("role")))
    return F.when(F.size(linked) > 0, linked).otherwise(bare)


def object_title(text: Column) -> Column:
    """The title of an object in its text: quoted behind ``intitulé``, behind ``Objet :``, else the first quoted phrase."""
    return compact(F.coalesce(_found(text, r"(?is)intitul[ée]e?\s*:?\s*[«\"“]\s*([^»\"”]{6,200}?)\s*[»\"”]"), _found(text, r"(?im)^\s*Objet\s*:\s*(.{6,200})$"), _found(text, r"(?s)[«\"“]\s*([^»\"”]{6,200}?)\s*[»\"”]")))


# ---- references and lines ---------------------------------------------------------------------------------------


def reference(text: Column, short: Column) -> Column:
    """The normal form of a response's reference: ``RI nn/yyyy``, or the number written out where ``short`` is false; other text stays."""
    t = compact(text)
    year_first, ri, bare = r"(?i)^(20\d{2})\s*/\s*ri\s*0*(\d+)([a-z]*)$", r"(?i)^ri\s*0*(\d+)([a-z]*)\s*/\s*(20\d{2})$", r"^0*(\d+)\s*/\s*(20\d{2})$"
    padded = lambda n: F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    ex = F.regexp_extract
    return (
        F.when(t.rlike(year_first), F.concat(F.lit("RI "), padded(ex(t, year_first, 2)), F.lower(ex(t, year_first, 3)), F.lit("/"), ex(t, year_first, 1)))
        .when(t.rlike(ri), F.concat(F.lit("RI "), padded(ex(t, ri, 1)), F.lower(ex(t, ri, 2)), F.lit("/"), ex(t, ri, 3)))
        .when(t.rlike(bare) & short, F.concat(F.lit("RI "), padded(ex(t, bare, 1)), F.lit("/"), ex(t, bare, 2)))
        .when(t.rlike(bare), F.concat(F.lit("Réponse municipale n° "), ex(t, bare, 1), F.lit("/"), ex(t, bare, 2))).otherwise(t)
    )


#: Labels of political objects (fixed values).
OBJECT_LABELS = {"interpellation": "Interpellation", "postulat": "Postulat", "motion": "Motion"}


def title_parts(category: Column, title: Column, authors: Column) -> Column:
    """Label, author and subject of a political title: those it names itself, else the category's label, the authors given and what is left of the title."""
    p = r"(?i)^(?:(Interpellation|Motion|Postulat)|(?:Complément de )?réponse à l['’]interpellation)\s+(?:de|du|des|d['’])\s+(.+?),?\s+(?:intitul[ée]e?|ayant pour titre)\s*[«\"]\s*(.+?)\s*[»\"]\s*(.*?)\s*$"
    t, label = F.trim(title), label_of(category, OBJECT_LABELS)
    own = F.initcap(F.lower(F.coalesce(_found(t, p), F.lit("Interpellation"))))
    stem = F.when(F.lower(t).endswith(".pdf"), F.replace(F.element_at(F.split(F.substr(t, F.lit(1), F.length(t) - 4), "_"), -1), F.lit("-"), F.lit(" "))).otherwise(t)
    rest = F.regexp_replace(stem, F.concat(F.lit("(?i)^"), label, F.lit(r"\s*[:–—-]?\s*")), F.lit(""))
    rest = F.regexp_replace(rest, "^[ «»\"]+|[ «»\"]+$", "")
    return F.when(t.rlike(p), F.struct(own.alias("label"), F.regexp_extract(t, p, 2).alias("author"), F.trim(F.concat_ws(" ", F.regexp_extract(t, p, 3), F.nullif(F.regexp_extract(t, p, 4), F.lit("")))).alias("subject"))).otherwise(
        F.struct(label.alias("label"), authors.alias("author"), F.when(rest == "", t).otherwise(rest).alias("subject"))
    )


def answer_line(label: Column, author: Column, subject: Column, day: Column, reference_: Column, url: Column) -> Column:
    """A Markdown line for an object: label, author and subject, then the response's reference with its date, or the date alone, and a link."""
    when = F.when(reference_.isNotNull(), F.concat_ws(", ", reference_, dates.french_date(day))).otherwise(dates.french_date(day))
    head = F.concat_ws(" ", F.concat(F.lit("**"), label, F.lit("**")), F.concat(F.lit("de "), author), F.concat(F.lit("« "), subject, F.lit(" »")))
    return F.concat(F.lit("- "), F.concat_ws(" – ", head, when, F.when(url.rlike("^(?i)https?://"), F.concat(F.lit("[PDF]("), url, F.lit(")")))))


def source_links(answer: Column, urls: Column) -> Column:
    """An answer without the lines that hold nothing but sources, its other ``Source n`` made links to the n-th of ``urls``; numbers without a URL stay."""
    lines = F.filter(F.split(answer, "\n"), lambda x: ~x.rlike(r"(?i)^[\s*_()\[\]-]*sources?\s*:?\s*(?:n°\s*)?\d+(?:\s*(?:,|et|;)\s*(?:source\s*)?\d+)*[\s*_.()\[\]-]*$"))
    # each mark is a piece of its own
    pieces = F.split(F.array_join(lines, "\n"), r"(?i)(?=\bSource \d+\b)|(?<=\bSource \d)(?!\d)|(?<=\bSource \d\d)(?!\d)")
    number = lambda x: _found(x, r"(?i)\ASource (\d+)\z").try_cast("int")
    return F.array_join(F.transform(pieces, lambda x: F.when(number(x).isNotNull() & F.try_element_at(urls, F.greatest(number(x), F.lit(1))).isNotNull(), F.concat(F.lit("["), x, F.lit("]("), F.try_element_at(urls, F.greatest(number(x), F.lit(1))), F.lit(")"))).otherwise(x)), "")


def html_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def salvaged_json(answer: Column, schema: str) -> Column:
    """The object in a model's answer: within its outermost braces, whatever fences and words stand around."""
    return F.from_json(_found(answer, r"(?s)(\{.*\})"), schema)


def salvaged_array(answer: Column, schema: str) -> Column:
    return F.from_json(_found(answer, r"(?s)(\[.*\])"), schema)


def follows_up(question: Column, hints: Sequence[str]) -> Column:
    """Whether a question goes on from the ones before: up to four words, or one of the hints among its words."""
    words = F.regexp_extract_all(fold(question), F.lit("[a-z0-9]+"), F.lit(0))
    return (F.size(words) > 0) & ((F.size(words) <= 4) | F.arrays_overlap(words, F.array(*[F.lit(h) for h in hints])))


def in_context(question: Column, history: Column, hints: Sequence[str], most: int = 4, chars: int = 1200) -> Column:
    """A follow-up question with the last messages before it (structs ``role`` and ``content``); any other one as it is."""
    kept = F.filter(F.slice(history, F.greatest(F.size(history) - most + 1, F.lit(1)), F.lit(most)), lambda m: F.trim(m["content"]) != "")
    line = lambda m: F.concat(F.when(m["role"] == "user", "Utilisateur").otherwise("Assistant"), F.lit(": "), F.left(compact(F.regexp_replace(m["content"], r"(?s)\nSources utilisées:.*", "")), F.lit(chars)))
    before = F.array_join(F.transform(kept, line), "\n")
    return F.when(follows_up(question, hints) & (before != ""), F.concat(F.lit("Question de suivi dans une conversation.\nContexte récent:\n"), before, F.lit("\n\nQuestion actuelle: "), question)).otherwise(question)


#: Categories by what stands in a URL's path, in order (fixed values).
URL_CATEGORIES = (
    ("proces-verbaux", "proces-verbaux"), ("preavis", "preavis-municipaux"), ("communications", "communications-municipales"), ("informations-diverses", "informations-diverses"),
    ("rapport-de-gestion", "rapport-de-gestion"), ("/budget/", "budget"),
)


def url_category(url: Column) -> Column:
    """The category that a document's URL names: that of its file among motions and postulates, else by its path, else ``autres``."""
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(url, r"[?#].*$", "")), url))
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    mixed = F.when(file.contains("interpellation"), "interpellations").when(file.contains("postulat"), "postulats").otherwise("motions")
    out = F.when(path.contains("/motions-postulats/"), mixed)
    for part, category in URL_CATEGORIES:
        out = out.when(path.contains(part), category)
    return out.otherwise("autres")


def url_year_or(url: Column, fallback: Column) -> Column:
    """The year of a URL's folder, else the first in its file's name, else ``fallback``."""
    path = F.coalesce(F.try_url_decode(F.regexp_replace(url, r"[?#].*$", "")), url)
    return F.coalesce(dates.url_year(path), _found(F.regexp_extract(path, r"([^/]*)$", 1), r"(20\d{2})"), fallback)


def all_authors(by_category: Column) -> Column:
    """The authors of a map from categories to arrays of persons, as they are shown, each once, in order."""
    from civicspark.functions.text import author_display

    persons = F.flatten(F.map_values(by_category))
    shown = F.transform(F.filter(persons, lambda a: F.trim(F.coalesce(a["name"], F.lit(""))) != ""), lambda a: author_display(a["civility"], a["name"], a["party"]))
    return F.array_distinct(shown)
