"""Column expressions on dates, years, amounts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.text import compact, first_truthy, fold

#: French months (fixed values).
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
LONG_DATE = r"\b(\d{1,2})(?:er)?\s+(janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)\s+((?:19|20)\d{2})\b"


def month_number(name: Column) -> Column:
    folded = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
    return F.create_map(*[x for i, m in enumerate(folded, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])[name]


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def long_date(text: Column) -> Column:
    """The first French date such as ``1er mars 2024``, in ISO form; null if there is none or the day doesn't exist."""
    t = fold(text)
    day, month, year = (F.regexp_extract(t, LONG_DATE, i) for i in (1, 2, 3))
    return F.when(day != "", _iso(year, month_number(month), day))


def last_long_date(text: Column) -> Column:
    """The last French date of the text, in ISO form."""
    found = F.regexp_extract_all(fold(text), F.lit(LONG_DATE), F.lit(0))
    return F.when(F.size(found) > 0, long_date(F.element_at(F.concat(F.array(F.lit("")), found), -1)))


def swiss_date(text: Column) -> Column:
    """``dd.mm.yyyy`` in ISO form."""
    p = r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})\s*$"
    return F.when(text.rlike(p), _iso(F.regexp_extract(text, p, 3), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 1)))


def iso_in_name(text: Column) -> Column:
    """The first ISO date in a file name that no digit touches."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(20\d{2}-\d{2}-\d{2})(?!\d)", 1), F.lit(""))


def letter_date(text: Column, chars: int = 1800) -> Column:
    """The first French date in the beginning of a letter."""
    return long_date(F.left(text, F.lit(chars)))


def french_date(iso: Column) -> Column:
    """An ISO date written out; other text stays."""
    p = r"^(\d{4})-(\d{2})-(\d{2})$"
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(f"{i:02d}"), F.lit(m))])
    day = F.regexp_extract(iso, p, 3).try_cast("int")
    written = F.concat_ws(" ", F.when(day == 1, "1er").otherwise(day.cast("string")), months[F.regexp_extract(iso, p, 2)], F.regexp_extract(iso, p, 1))
    return F.when(iso.rlike(p) & F.regexp_extract(iso, p, 2).between("01", "12"), written).otherwise(iso)


def first_year(text: Column) -> Column:
    """The first year from 2000 to 2099 that stands alone."""
    return F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit(""))


def derived_year(listing_year: Column, legislature: Column, date: Column) -> Column:
    """Listing year, or else the year of the date; empty strings count as absent."""
    return F.coalesce(F.nullif(listing_year.cast("string"), F.lit("")), F.nullif(F.left(date, F.lit(4)), F.lit("")))


def url_year(url: Column) -> Column:
    """The year that is a segment of a URL's path."""
    return F.nullif(F.regexp_extract(url, r"/(20\d{2})/", 1), F.lit(""))


def official_date(letter: Column, adoption: Column, response: Column) -> Column:
    """The letter's date before the adoption's before the response's."""
    return first_truthy(letter, adoption, response)


def year_issues(listing_year: Column, date: Column, url: Column, legislature: Column) -> Column:
    """What contradicts the year of a document, sorted."""
    year, of_url = F.left(date, F.lit(4)).try_cast("int"), url_year(url).try_cast("int")
    low, high = F.regexp_extract(legislature, r"^(\d{4})-(\d{4})$", 1).try_cast("int"), F.regexp_extract(legislature, r"^(\d{4})-(\d{4})$", 2).try_cast("int")
    rules = {
        "date_outside_legislature": (year < low) | (year > high), "listing_year_differs_from_date": listing_year != year, "listing_year_differs_from_url": listing_year != of_url,
        "missing_date": date.isNull(), "missing_listing_year": listing_year.isNull(),
    }
    return F.filter(F.array(*[F.when(rule, name) for name, rule in sorted(rules.items())]), lambda x: x.isNotNull())


def amounts(text: Column) -> Column:
    """All CHF amounts as numbers; apostrophes separate thousands, a comma or point the decimals."""
    found = F.regexp_extract_all(text, F.lit(r"CHF\s*(\d[\d'’]*(?:[.,]\d{1,2})?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.translate(x, "'’", ""), F.lit(","), F.lit(".")).try_cast("double"))


def signed_total(text: Column, label: str) -> Column:
    """The amount behind ``label``, negative if it is called a deficit or loss; in millions if so written."""
    p = rf"(?i){label}[^\d\n]{{0,40}}?(\d[\d'’]*(?:[.,]\d+)?)\s*(millions?|mio)?"
    value = F.replace(F.translate(F.regexp_extract(text, p, 1), "'’", ""), F.lit(","), F.lit(".")).try_cast("double")
    scaled = F.when(F.regexp_extract(text, p, 2) != "", value * 1e6).otherwise(value)
    return F.when(fold(F.regexp_extract(text, p, 0)).rlike("deficit|perte"), -scaled).otherwise(scaled)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with collapsed white space."""
    return F.sha2(compact(text), 256)


def raw_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_id(text: Column) -> Column:
    """``doc_`` and the first twenty digits of the hash."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(text, 256), F.lit(20)))


def url_id(url: Column) -> Column:
    """The stem of a URL's file name and the first eight digits of the URL's SHA-1."""
    stem = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    return F.concat(stem, F.lit("-"), F.left(F.sha1(url), F.lit(8)))


def hmac_sha256(text: Column, key: str) -> Column:
    """Keyed fingerprint of a text, by the two nested hashes of RFC 2104; keys longer than a block are hashed first."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def needs_ocr(chars: Column, pages: Column, base: int = 200, per_page: int = 50) -> Column:
    """Whether a document has too little text for its pages."""
    return chars < F.greatest(F.lit(base), F.lit(per_page) * pages)


def article_key(article: Column) -> Column:
    """Sort key of article numbers: 12 < 12bis < 12ter < 13."""
    number = F.regexp_extract(article, r"^(\d+)", 1).try_cast("int")
    suffix = F.lower(F.regexp_extract(article, r"^\d+\s*([A-Za-z]*)", 1))
    rank = F.when(suffix == "", 0).when(suffix == "bis", 1).when(suffix == "ter", 2).when(suffix == "quater", 3).otherwise(4)
    return F.struct(F.coalesce(number, F.lit(2**31 - 1)).alias("number"), rank.alias("rank"), suffix.alias("suffix"))
