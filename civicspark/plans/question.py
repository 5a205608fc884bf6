"""From a French question to a frozen specification, and from that to one DataFrame.

Everything here works on one question on the driver; only ``compile_spec``
touches data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.operators import browse, objects, retrieval

#: Wordings that ask for objects with, and without, a response (fixed values).
WITH_RESPONSE = ("ont recu une reponse", "ayant recu une reponse", "avec une reponse", "avec reponse", "reponse disponible", "reponses disponibles", "reponse fournie", "reponses fournies")
WITHOUT_RESPONSE = ("sans reponse", "pas de reponse", "pas recu de reponse", "n'ont pas recu", "non repondu", "en attente de reponse", "restees sans reponse", "restes sans reponse")
#: Wordings that ask for a number or a list, and for authors by civility (fixed values).
COUNTING = ("combien de", "combien d'", "liste tous", "liste toutes", "quel est le nombre de")
CIVILITIES = {"femmes": "Mme", "femme": "Mme", "hommes": "M.", "homme": "M."}
#: Types of documents with the words that speak of them, in order of precedence (fixed values).
TYPE_CUES = {
    "interpellations": r"interpellation", "postulats": r"postulat", "motions": r"motion", "budget": r"budget",
    "reglement-conseil-communal": r"reglement|\brcc\b|article.*?(?:conseil|communal)|(?:conseil|communal).*?article",
}
#: Words that tell that a question may have to be taken apart (fixed values).
COMPARING = ("a la fois", "ainsi que", "compar", "crois", "difference", "en commun", "meme annee", "respectivement", "tous les deux", "versus")
#: Words that go on from an earlier question (fixed values).
GOING_ON = frozenset("alors aussi ca cela celles celle celui ceux combien donc meme precedent precedente quoi somme total".split())
SINGULAR = {"interpellations": "interpellation", "postulats": "postulat", "motions": "motion"}


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("’", "'")) if not unicodedata.combining(c))


@dataclass(frozen=True)
class QuerySpec:
    """What a question asks for; ``route`` is search, count, answered or unanswered."""

    route: str = "search"
    city: str | None = None
    doc_type: str | None = None
    year: str | None = None
    year_range: tuple[str, str] | None = None
    response_year: str | None = None
    civility: str | None = None
    article: str | None = None
    phrases: tuple[str, ...] = field(default_factory=tuple)
    keywords: tuple[str, ...] = field(default_factory=tuple)

    def filters(self) -> dict:
        return {k: v for k, v in (("city", self.city), ("doc_type", self.doc_type), ("year", self.year)) if v}


def mentioned(question: str, names: dict[str, str]) -> dict[str, int]:
    """The labels whose name or alias stands in a folded question as whole words, with the length of the longest such name."""
    out: dict[str, int] = {}
    for name, label in names.items():
        key = plain(name)
        if re.search(rf"(?<!\w){re.escape(key)}(?!\w)", question):
            out[label] = max(len(key), out.get(label, 0))
    return out


def find_city(question: str, names: dict[str, str]) -> str | None:
    """The label with the longest name in the question; of equal ones the first in ``names``."""
    found = mentioned(question, names)
    return max(found, key=found.__getitem__, default=None)


def types_in(question: str) -> list[str]:
    """The types of documents a question speaks of, in order of precedence."""
    return [kind for kind, cue in TYPE_CUES.items() if re.search(cue, question)]


def find_range(question: str) -> tuple[str, str] | None:
    """Two years in order, from ``entre 2021 et 2023`` or ``2021-2023``; the wording with ``entre`` comes first."""
    spans = re.finditer(r"\b(?P<a>20\d{2})\s*(?P<sign>et|[-–—])\s*(?P<b>20\d{2})\b", question)
    ranked = sorted((m["sign"] != "et", m.start(), m["a"], m["b"]) for m in spans if m["sign"] != "et" or question[: m.start()].rstrip().endswith("entre"))
    return (min(ranked[0][2:]), max(ranked[0][2:])) if ranked else None


def understand(question: str, names: dict[str, str], ui: dict | None = None) -> QuerySpec:
    """The specification of a question; filters chosen beside it win unless they are ``all``.

    A year in a question for answered objects is that of the response, in one
    for unanswered ones that of filing.
    """
    q = plain(question)
    kind, span = next(iter(types_in(q)), None), find_range(q)
    year = None if span or not (m := re.search(r"\b(20\d{2})\b", q)) else m[1]
    listing = re.search(r"\b(?:quel(?:le)?s?|liste(?:r)?|combien)\b", q) is not None
    countable = kind in SINGULAR
    route = "search"
    if countable and listing and any(w in q for w in WITHOUT_RESPONSE):
        route = "unanswered"
    elif countable and listing and any(w in q for w in WITH_RESPONSE):
        route = "answered"
    elif countable and any(w in q for w in COUNTING):
        route = "count"
    article = re.search(r"\barticles?\s+(\d+(?:bis|ter|quater)?)\b", q)
    phrases = tuple(p.strip() for style in ('"([^"]{3,200})"', r"«\s*([^»]{3,200})\s*»", "“([^”]{3,200})”") for p in re.findall(style, question) if len(p.strip()) >= 6 and " " in p.strip())
    words = re.findall(r"[^\W\d_][\w\-']*", question)
    from civicspark.functions.text import COMMON_CAPITALIZED

    keywords = tuple(w for i, w in enumerate(words) if i and w[0].isupper() and len(w) >= 4 and plain(w) not in COMMON_CAPITALIZED)
    civility = next((c for w, c in CIVILITIES.items() if re.search(rf"\b{w}\b", q)), None)
    spec = QuerySpec(
        route, find_city(q, names), kind, None if route == "answered" else year, span, year if route == "answered" else None, civility if route == "count" else None,
        article[1] if article else None, tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(keywords)),
    )
    for key, value in (ui or {}).items():
        if value and str(value).lower() != "all" and key in ("city", "doc_type", "year"):
            spec = replace(spec, **{key: str(value)})
    return spec


def conflict(question: str, chosen: dict, towns: dict[str, dict]) -> str | None:
    """What speaks against searching with the chosen filters, or None.

    ``towns`` has for each label ``enabled``, ``types`` and ``names``.  In
    order: a town in the question that has no documents yet, such a town among
    the filters, types that a town in question doesn't have, a year or a type
    in the question that isn't the chosen one.
    """
    q = plain(question)
    picked = {k: str(v) for k, v in chosen.items() if v and str(v).lower() != "all"}
    named = mentioned(q, {n: label for label, t in towns.items() for n in (label, *t["names"])})
    city, kinds = picked.get("city"), set(types_in(q))
    if any(not towns[label]["enabled"] for label in named):
        return "town_unavailable"
    if city and not towns.get(city, {}).get("enabled"):
        return "city_unavailable"
    wanted = {SINGULAR.get(k, k) for k in kinds | ({picked["doc_type"]} if "doc_type" in picked else set())}
    if any(wanted - set(towns[label]["types"]) for label in ([city] if city else named)):
        return "type_unavailable"
    years = set(re.findall(r"\b20\d{2}\b", q))
    if years and picked.get("year", next(iter(years))) not in years:
        return "year"
    return "type" if kinds and picked.get("doc_type", next(iter(kinds))) not in kinds else None


def is_complex(question: str) -> bool:
    """Whether a question may have to be taken apart: it compares, quotes two titles, joins words by et, ou, entre or contre outside quotes, or names two years."""
    quotes = re.compile(r'"[^"]*"|«[^»]*»|“[^”]*”')
    q = plain(question)
    return (
        any(w in q for w in COMPARING) or len(quotes.findall(question)) > 1 or len(set(re.findall(r"\b20\d{2}\b", q))) > 1
        or not {"et", "ou", "entre", "contre"}.isdisjoint(re.findall(r"\w+", quotes.sub(" ", q)))
    )


def follows_up(question: str) -> bool:
    """Whether a question goes on from the ones before: it has up to four words, or one of those that go on."""
    words = re.findall(r"[a-z0-9]+", plain(question))
    return 0 < len(words) and (len(words) < 5 or not GOING_ON.isdisjoint(words))


def compile_spec(spec: QuerySpec, documents: DataFrame, chunks: DataFrame, vector: Sequence[float] | None = None, limit: int = 20, links: DataFrame | None = None) -> DataFrame:
    """The DataFrame that answers a specification; ``links`` are the stored ones of objects to responses (see ``objects.answered``), else those by common number."""
    if spec.route == "answered":
        own, links, responses = _linked(documents, spec, links)
        entries = own.select("object_id", F.lit(0).alias("entry_no"), *[F.lit(None).cast("string").alias(x) for x in ("response_number", "adoption_date", "entry_date")]).where("false")
        return objects.answered(own, entries, links, responses, year=spec.response_year)
    if spec.route == "unanswered":
        return objects.unanswered(*_linked(documents, spec, links), spec.year)
    rows = documents.where(browse.filters(spec.filters()))
    if spec.year_range:
        rows = rows.where(browse.year_between(browse.browser_year(F.col("document_date"), F.col("listing_year")), *spec.year_range))
    if spec.route == "count":
        people = browse.author_listing(rows)
        people = people.where(F.col("civility").isin({"Mme": ["Mme", "Madame"], "M.": ["M.", "Monsieur"]}[spec.civility])) if spec.civility else people
        return people.groupBy("name").agg(F.count_distinct("document_id").alias("documents")).orderBy(F.desc("documents"), "name")
    scope = chunks.join(rows.select("document_id").distinct(), "document_id", "left_semi")
    empty = scope.select("chunk_id", "document_id", F.lit(0.0).alias("score")).where("false")
    titles, words, near = empty, empty, empty
    for phrase in spec.phrases:
        titles = titles.unionByName(retrieval.title_search(chunks, _in_city(documents, spec), phrase).select("chunk_id", "document_id", "score"))
    for word in spec.keywords:
        words = words.unionByName(retrieval.keyword_search(scope, rows, word).select("chunk_id", "document_id", "score"))
    if vector is not None:
        near = retrieval.vector_search(scope, vector, limit).select("chunk_id", "document_id", "score")
    return retrieval.fuse(titles, words, near, limit)


def _in_city(documents: DataFrame, spec: QuerySpec) -> DataFrame:
    return documents.where(F.col("commune") == spec.city) if spec.city else documents


def _linked(documents: DataFrame, spec: QuerySpec, links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The objects a question asks for, the links of all objects to responses, and the responses."""
    once = documents.groupBy("document_id").agg(*[F.max(x).alias(x) for x in ("commune", "category", "document_role", "document_date", "listing_year")])
    own = _in_city(once, spec).where((F.col("category") == SINGULAR[spec.doc_type or ""]) & F.col("document_role").endswith("_text"))
    links = links if links is not None else retrieval.responses(documents).where("response_id is not null").withColumn("position", F.lit(0))
    empty = F.lit("")
    # a response without a number of its own is one entry
    answers = once.where("document_role = 'municipal_response'").select(
        F.col("document_id").alias("response_id"), F.array(empty).alias("numbers"), F.col("document_role").alias("role"), empty.alias("text"), "document_date", "listing_year", empty.alias("reference")
    )
    return own.select(F.col("document_id").alias("object_id"), F.col("document_date").alias("political_date"), "listing_year"), links, answers
