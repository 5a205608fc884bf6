"""Column expressions on text.  Null input gives null unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Letters with a mark and their base letters; ligatures stay (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
BASE = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
#: HTML entities that occur in listings (fixed values).
ENTITIES = {
    "&nbsp;": " ", "&eacute;": "é", "&egrave;": "è", "&ecirc;": "ê", "&euml;": "ë", "&agrave;": "à", "&acirc;": "â", "&ccedil;": "ç", "&ugrave;": "ù",
    "&ucirc;": "û", "&ocirc;": "ô", "&ouml;": "ö", "&uuml;": "ü", "&icirc;": "î", "&iuml;": "ï", "&Eacute;": "É", "&Agrave;": "À", "&rsquo;": "’", "&laquo;": "«",
    "&raquo;": "»", "&ndash;": "–", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}


def compact(text: Column) -> Column:
    """White space, no-break spaces and line ends included, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_accents(text: Column) -> Column:
    """Letters without their marks, whether composed or followed by combining marks."""
    return F.regexp_replace(F.translate(text, MARKED, BASE), r"\p{M}", "")


def fold(text: Column) -> Column:
    return F.lower(strip_accents(text))


def normalized_words(text: Column) -> Column:
    """Lower case without accents; everything but letters a to z and digits becomes one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def slug(text: Column, length: int | None = None) -> Column:
    """Words joined by hyphens, cut to ``length`` characters if given."""
    full = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.left(full, F.lit(length)) if length else full


def unescape(text: Column) -> Column:
    """HTML entities of the fixed table replaced, the ampersand last."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(text: Column) -> Column:
    """Text of an HTML fragment: tags become spaces, entities are replaced, spaces collapse."""
    return compact(unescape(F.regexp_replace(text, "<[^>]+>", " ")))


def clean_text(text: Column) -> Column:
    """Entities replaced, no-break spaces and control characters removed, at most one blank line in a row."""
    plain = F.regexp_replace(F.translate(unescape(text), "  \u0000", "  "), r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "")
    lines = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def lexical_word_count(text: Column) -> Column:
    """Words that begin with a letter or digit; apostrophes and hyphens join."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+[\w'-]*\b"))


def page_markers(text: Column) -> Column:
    """How often a marker such as ``3 | 12`` stands in the text."""
    return F.regexp_count(text, F.lit(r"\b\d{1,3}\s*\|\s*\d{1,3}\b"))


def without_page_markers(text: Column) -> Column:
    return compact(F.regexp_replace(text, r"\b\d{1,3}\s*\|\s*\d{1,3}\b", " "))


def without_page_lines(text: Column) -> Column:
    """Lines that hold only a page number are dropped; runs of blank lines collapse."""
    lines = F.transform(F.split(text, "\n"), lambda x: compact(x))
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^page \d+(?:\s*(?:/|sur|de)\s*\d+)?$|^\d{1,3}\s*/\s*\d{1,3}$"))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def quoted_phrases(text: Column) -> Column:
    """Quoted phrases of at least six characters that hold a space, in the order of the three styles of quotes."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ('"([^"]{3,200})"', r"«\s*([^»]{3,200})\s*»", "“([^”]{3,200})”")])
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (F.length(x) >= 6) & x.contains(" ")))


#: Words that are capitalized by habit (fixed values).
COMMON_CAPITALIZED = "je tu il elle on nous vous ils elles le la les un une des du de et ou a que qui quoi quel quelle quels quelles combien comment pourquoi quand est sont commune municipalite ville conseil".split()


def capitalized_keywords(text: Column) -> Column:
    """Capitalized words of at least four letters, but for the first word and common ones."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{N}_'-]*"), F.lit(0))
    return F.filter(words, lambda w, i: (i > 0) & (F.length(w) >= 4) & w.rlike(r"^\p{Lu}") & ~fold(w).isin(COMMON_CAPITALIZED))


def excerpt(text: Column, length: int = 220) -> Column:
    """The beginning of the text on one line."""
    return F.left(F.regexp_replace(text, r"[\r\n]+", " "), F.lit(length))


def truncated(text: Column, length: int) -> Column:
    return F.left(compact(text), F.lit(length))


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def ilike_contains(text: Column, keyword: str) -> Column:
    """Case-insensitive containment; per cent signs and underscores are wildcards, backslashes are literal."""
    return text.ilike("%" + keyword.replace("\\", "\\\\") + "%")


def matches_keywords(keywords: Sequence[str], *fields: Column) -> Column:
    """Every keyword is found in at least one field; nulls hold nothing, and no keyword matches all."""
    out = F.lit(True)
    for keyword in keywords:
        any_field = F.lit(False)
        for field in fields:
            any_field = any_field | F.coalesce(ilike_contains(field, keyword), F.lit(False))
        out = out & any_field
    return out


def chf(amount: Column) -> Column:
    """An amount with two decimals and apostrophes between thousands."""
    return F.replace(F.format_number(amount, 2), F.lit(","), F.lit("'"))


def listed(items: Column) -> Column:
    """French enumeration: ``a, b et c``; empty for an empty array."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" et "), F.element_at(F.concat(F.array(F.lit("")), items), -1))
    )


def valid_email(text: Column) -> Column:
    """Whether the trimmed text is an address; null and empty text are not."""
    return F.coalesce(F.lower(F.trim(text)).rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@.]{2,}\z"), F.lit(False))


def web_url(text: Column) -> Column:
    """The URL if its scheme is http or https, else null."""
    return F.when(text.rlike(r"^(?i)https?://"), text)


def query_value(url: Column, name: str) -> Column:
    """The decoded value of a query parameter, null if absent."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))


def basename(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def object_type(text: Column) -> Column:
    """The political type a free text speaks of: interpellation before postulat before motion."""
    t = fold(text)
    return F.when(t.contains("interpellation"), "interpellation").when(t.contains("postulat"), "postulat").when(t.contains("motion"), "motion")


#: Category as asked for and as stored (fixed values).
CATEGORIES = {
    "motions": "motion", "postulats": "postulat", "interpellations": "interpellation", "preavis-municipaux": "preavis_municipal", "proces-verbaux": "proces_verbal",
    "rapports-comptes": "rapport_comptes", "rapports-gestion": "rapport_gestion", "reglement-conseil-communal": "reglement_conseil_communal", "budget": "budget",
}


def status_code(text: Column) -> Column:
    """Normal form of a status label: answered, pending, withdrawn, accepted, rejected or other."""
    t = fold(text)
    return (
        F.when(t.rlike("repondu|reponse|liquid|traite"), "answered").when(t.rlike("retire"), "withdrawn").when(t.rlike("accept|pris en consideration|renvoye"), "accepted")
        .when(t.rlike("refus|rejet"), "rejected").when(t.rlike("attente|cours|suspens"), "pending").when(text.isNotNull(), "other")
    )


def facets(text: Column, terms: dict[str, Sequence[str]]) -> Column:
    """The names of the facets of which a term is found, sorted."""
    t = fold(text)
    tests = []
    for name, words in sorted(terms.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | t.contains(word)
        tests.append(F.when(hit, name))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


#: Topics and the beginnings of words that speak of them (fixed values).
TOPICS = {
    "ecoles": ["ecole", "scolaire", "ecolier"], "energie": ["energie", "chauffage", "electri", "photovolta", "solaire"], "finances": ["budget", "impot", "imposition", "credit", "dette", "comptes"],
    "mobilite": ["bus", "velo", "cyclable", "stationnement", "circulation", "pieton"], "urbanisme": ["quartier", "construction", "parcelle", "logement", "immeuble"],
}


def author_parts(text: Column) -> Column:
    """Civility, name and party of ``M. X (PARTY)``: a struct whose parts are null where absent."""
    pattern = r"^\s*(?:(M\.|Mme|Mlle|Monsieur|Madame)\s+)?([^()]+?)\s*(?:\(([^)]+)\))?\s*$"
    title = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    civility = F.when(title.isin("M.", "Monsieur"), "M.").when(title.isNotNull(), "Mme")
    return F.struct(civility.alias("civility"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("name"), F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")).alias("party"))


def author_display(civility: Column, name: Column, party: Column) -> Column:
    """The name with civility before and party behind it, unless it has them already."""
    head = F.when(civility.isNotNull() & ~name.startswith(civility), F.concat(civility, F.lit(" "), name)).otherwise(name)
    return F.when(party.isNotNull() & ~name.contains(F.concat(F.lit("("), party)), F.concat(head, F.lit(" ("), party, F.lit(")"))).otherwise(head)


def response_reference(text: Column) -> Column:
    """``RI nn/yyyy`` from the ways a response is referred to, the number with two digits; null if there is none."""
    pattern = r"(?i)\b(?:RI|r[ée]ponse(?: municipale)?)\s*(?:n[°o]\.?\s*)?(\d{1,3})\s*[/-]\s*((?:20)?\d{2})\b"
    number, year = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(number != "", F.concat(F.lit("RI "), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("/"), year))


def cleaned_values(df: DataFrame, clean: Callable[[Column], Column] = clean_text) -> DataFrame:
    """Every text of the table cleaned, within structs, arrays and the values of maps as well."""

    def one(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return clean(value)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: one(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, x: one(x, kind.valueType))
        if isinstance(kind, StructType):
            return F.when(value.isNotNull(), F.struct(*[one(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return df.select(*[one(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def badness(text: Column) -> Column:
    """How many sequences of wrong decoding a text holds; the smaller of two readings is the better one."""
    return F.regexp_count(text, F.lit("Ã|Â|â€|Ð|�|[\u0080-\u009f]"))


def reread(text: Column) -> Column:
    """The text as it is, or read again as UTF-8 from Latin-1 or Windows-1252, whichever is least bad; ties keep the text.

    A reading is only tried where every character exists in the encoding.
    """
    bytes_ = F.encode(text, "ISO-8859-1")
    latin = F.when(~text.rlike("[^\u0000-\u00ff]") & F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string"))
    windows = F.when(
        ~text.rlike("[^\u0000-\u007f -ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"),
        F.try_reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), F.try_reflect(F.lit("java.net.URLEncoder"), F.lit("encode"), text, F.lit("windows-1252")), F.lit("UTF-8")),
    )
    best = F.array_min(
        F.filter(
            F.array(*[F.struct(badness(c).alias("bad"), F.lit(i).alias("i"), c.alias("text")) for i, c in enumerate((text, latin, windows))]), lambda x: x["text"].isNotNull()
        )
    )
    return F.when(badness(text) > 0, best["text"]).otherwise(text)
