"""Properties of single lines that several operators on scanned or published text share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Month names in the languages of the texts (fixed values).
MONTHS = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre januar februar marz april juni juli august oktober dezember gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre dicembre"
_DATE = re.compile(rf"\b\d{{1,2}}(?:er|\.)?\s+(?:{'|'.join(MONTHS.split())})\s+\d{{4}}\b|\b\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}\b")
_DIGIT, _NUMBER, _NO_WORD = re.compile(r"\d"), re.compile(r"\d+(?:['.,]\d+)*"), re.compile(r"[^a-z0]+")
_MARKS = re.compile("[̀-ͯ]+")
_PAGE = re.compile(r"(?:seite\s*/\s*)?(?:pages?|p\.?|pag\.?|seite|s\.)\s*\d{1,4}(?:\s*(?:sur|de|/|von|of|di)\s*\d{1,4})?|\d{1,3}\s*/\s*\d{1,3}|\d{1,3}|[\[(]\s*\d{1,4}\s*[\])]|[-–—]+\s*\d{1,4}\s*[-–—]+")
#: Glyphs that scanners take for one another, as they look alike; both sides become the second (fixed values).
GLYPHS = {"0": "o", "1": "l", "|": "l", "†": "t", "5": "s", "9": "g", "6": "b", "í": "i", "ì": "i", "ﬁ": "fi", "ﬂ": "fl"}


def plain(text: str) -> str:
    """Lower case without accents, with single spaces and straight quotes."""
    return _plain(text) if len(text) <= 400 else _plain.__wrapped__(text)


@lru_cache(100_000)
def _plain(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    t = unicodedata.normalize("NFKD", text.lower().replace("œ", "oe").replace("’", "'").replace("­", ""))
    return " ".join(_MARKS.sub("", t).split())


def is_page_number(line: str) -> bool:
    """Whether the line holds only a page number or mark."""
    t = line.strip()
    return 0 < len(t) <= 24 and bool(_PAGE.fullmatch(plain(t)))


def masked(line: str) -> str:
    """The line with dates and numbers replaced by 0, without case, accents, punctuation and a leading mark."""
    t = plain(line)
    if not t.isalpha() and _DIGIT.search(t):
        t = _NUMBER.sub("0", _DATE.sub("0", t))
    return _NO_WORD.sub(" ", t).strip()


_HEAD = re.compile(r"^(.{2,60}?)\s[–—|·-]\s(.{2,30}?)\s?(?:n°|no|nr)\.?\s?(0(?:[-/]0)?)(?:\s[–—|·-]\s|$)")


def header_head(line: str) -> str | None:
    """What the running headers of a series have in common: the line up to its number, digits masked.

    Misread glyphs within words are put back first.  None if the line has no
    such form.
    """
    if not 8 <= len(line) <= 160 or not re.search(r"[–—|·]|\s-\s", line):
        return None
    t = plain(line)
    t = re.sub(r"\b\d+(?:[-/]\d+)*\b", lambda m: re.sub(r"\d+", "0", m[0]) if m[0].isascii() else m[0], t)
    t = re.sub(r"(?<=[a-z])[015†|]|[015†|](?=[a-z])", lambda m: GLYPHS.get(m[0], m[0]), t)
    m = _HEAD.match(t)
    return f"{m[1]}|{m[2]}" if m else None
