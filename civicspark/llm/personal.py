"""Personal information inside free text, and its replacement by typed placeholders.

Generators with high recall propose overlapping spans of each kind, among them
account numbers, dates, streets without number and pairs of capitalized words.
Boosted trees score a span by its format and by what stands around it.  They
are fitted on a bounded sample of the corpus' own candidates.  A candidate is
labelled by the word before it ("tel.", "account", "domicile", a title ...),
which the trees don't see; most candidates have no such word, and the trees
alone decide on them.  Spans above the calibrated threshold are kept, the best
one where they overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.functions.text import fold as fold_text
from civicspark.llm.boosting import Boosted
from civicspark.session import cut, spread

#: Documents of which the candidates are labelled to fit the trees, at most.
SAMPLE_DOCUMENTS = 3_000
#: Candidates of a kind and label (and names of one word apart) that the trees are fitted on, at most.
SAMPLE_CANDIDATES = 2_000
#: A token counts as a given name if it makes up this share of the tokens in sure contexts; so there are at most 2 / GIVEN_SHARE.
GIVEN_SHARE = 0.0015
KINDS = ("email", "phone", "national_id", "address", "name")

UP = "A-ZÀ-ÖØ-ÞŒ"
TITLE = r"(?:M\.|MM\.|Mr\.?|Mmes?|Mlle|Monsieur|Madame|Mademoiselle|Messieurs|Mesdames|Herrn?|Frau|Signora|Signor|Signore|Sig\.(?:ra)?|Mrs\.?|Ms\.?|Miss|Dr\.?|Maître|Me)"
PARTICLE = r"(?:de la|della|des|de|du|von|van|di|d’|d'|DE LA|DE|DU|DES|VON)"
WORD = rf"[{UP}][\w’'-]*\w"
INIT = rf"(?:[{UP}]\.(?:-[{UP}]\.)?)"
NUMBER = r"\d{1,4}\s?(?:bis|ter|quater|[A-Da-d])?(?![\w’']|[.:/]\d)"
TOWN = rf"(?:\s*[,–-]?\s*(?:CH-)?\d{{4,5}} [{UP}][\w’'-]*(?:[ ](?:[{UP}][\w’'-]+|la|le|les|sur|de|du))*)?"
STREET_FR = r"(?i:avenue|av\.|rue|ruelle|sentier|chemin|ch\.|route|rte|quai|place|pl\.|impasse|boulevard|bd\.?|bvd|allée|promenade|esplanade|square|passage|montée|cours|faubourg|fbg|venelle|escaliers?)"
LINK_FR = r"(?:(?i:de la|de l[’']|du|des|de|d[’']|aux?|en|sur|sous)\s?)?"
EMAIL = re.compile(
    r"[\w][\w.+-]*(?:\s?@\s?|\s?[\[({<]\s?(?:at|arobase|chez|ät)\s?[\])}>]\s?|\s(?:at|arobase)\s(?=[\w-]+(?:\.\w|\s?[\[({<]|\s(?:point|dot)\s))(?!\S*@))[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:point|dot|punkt|punto|\.)\s?[\])}>]\s?|\s(?:point|dot|punkt|punto)\s)[\w-]+)*"
    r"|(?<!\w)@\w+",
    re.I,
)
DIGITS = re.compile(r"(?<![\w’'])(?:\+|\(\+?)?\d(?:[\d()]|[ .\-/\xa0 ](?=[\d(]))*\d(?![\w’'])")
LETTER_ID = re.compile(r"[A-Z]\d{5,9}(?!\w)|[A-Z]-\d{4}/\d{4}")
AT_WORDS = ("@", "(at", "[at", "{at", "<at", "( at", "[ at", " at ", "arobase", "(chez", "[chez", "(ät", "[ät")
ADDRESS = [
    re.compile(rf"(?<!\w){STREET_FR}\s+{LINK_FR}[{UP}\d][\w’'-]*(?:\s(?:(?:de la|du|des|de|et|à)\s)?[{UP}][\w’'-]*){{0,3}}\s?,?\s{NUMBER}{TOWN}"),
    re.compile(rf"(?<!\w)(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Bei der|Unter der|Obere|Untere)\s)?[{UP}][\wäöüß-]*(?i:strasse|straße|str\.|platz|weg|gasse|allee|ring|hof|rain|steig|matte|halde|quai|promenade)\s{NUMBER}{TOWN}"),
    re.compile(rf"(?<!\w)(?i:via|viale|piazza|piazzale|corso|vicolo|strada|largo|salita|contrada|stradone|lungolago)\s(?:(?:dei|delle|della|del|degli|dello|di|al|alla|alle|ai)\s)?(?:(?:dell|all)[’'])?[{UP}][\w’'-]*(?:\s(?:(?:dei|della|del|di)\s)?[{UP}][\w’'-]*){{0,2}}\s?,?\s{NUMBER}{TOWN}"),
    re.compile(rf"(?<![\w’'])\d{{1,4}}[A-Da-d]?\s(?:[{UP}][\w’'-]+\s){{1,3}}(?:Road|Street|Lane|Avenue|Close|Way|Drive|Court|Square|Place|Gardens|Terrace|Crescent|Hill|Row|Grove|Rd|St|Ln|Ave)\b\.?{TOWN}"),
]
#: What the kinds of addresses are found by (fixed values).
STREETS = "avenue av. rue ruelle sentier chemin ch. route rte quai place pl. impasse boulevard bd bvd allée promenade esplanade square passage montée cours faubourg fbg venelle escalier".split()
STREETS_DE = "strasse straße str. platz weg gasse allee ring hof rain steig matte halde quai promenade".split()
STREETS_IT = "via viale piazza piazzale corso vicolo strada largo salita contrada stradone lungolago".split()
STREETS_EN = "Road Street Lane Avenue Close Way Drive Court Square Place Gardens Terrace Crescent Hill Row Grove".split()
STREET_ONLY = re.compile(rf"(?<!\w)(?:{STREET_FR}|(?i:via|viale|piazza|piazzale|corso|vicolo))\s+{LINK_FR}(?:(?i:dei|delle|della|del)\s)?[{UP}][\w’'-]*")
IN_WORD = frozenset("_.+-")
#: What titles and signatures are found by.
TITLE_WORDS = "m. mm. mr mme mlle monsieur madame mademoiselle messieurs mesdames herr frau signor sig. mrs ms miss dr maître me".split()
SIGNATURES = "signé gezeichnet signed firmato unterzeichnet".split()
TITLED = re.compile(rf"(?<!\w){TITLE}[ \xa0]((?:{PARTICLE}[ ]?)?(?:{INIT}|{WORD})(?:[ \xa0](?:{PARTICLE}[ ]?)?(?:{INIT}|{WORD}))?)")
SIGNED = re.compile(rf"(?:Signé|Gezeichnet|Signed|Firmato|Unterzeichnet)\s?:\s?((?:{INIT}|{WORD})[ \xa0](?:{PARTICLE} )?{WORD})")
IS_TITLE = re.compile(rf"{TITLE}$")
#: Words before a candidate that tell what it is; candidates are labelled by them (fixed values).
CUES = {
    "phone": re.compile(r"(?:tél|tel|téléphone|telefon|telefono|phone|portable|mobile|natel|fax)\W{0,6}$", re.I),
    "national_id": re.compile(r"(?:avs|ahv|ahv-nr|pièce|permis|carte|livret|\bid|ausweis)\W{0,4}$", re.I),
    "number": re.compile(r"(?:réf|ref|compte|konto|conto|facture|code|ratios?|horaire|version|chf|fr|art|iban|n°|nr|no|du|vom|del)\W{0,4}(?:\w-)?$", re.I),
    "address": re.compile(r"(?:domicile|domiciliée?|domiciliat[oa]|wohnhaft|\bof|depuis|adresse)\W{0,4}$", re.I),
    "place": re.compile(r"(?:\b(?:la|le|les|au|aux|du|cette|der|die|das|the)\s|l[’'])$", re.I),
    "email": re.compile(r"(?:courriel|mail|à|an|a|at)\s$", re.I),
    "signed": re.compile(r"(?:Signé|Gezeichnet|Signed|Firmato|Unterzeichnet)\s?:\s?$"),
    "ground": re.compile(r"(?:\b(?:entre|vers|quartier|secteur|parcelle|objet|pour|sur|quant à|côté de|variante de|rue|avenue|école|collège|à)|(?:préavis|postulat|motion|rapport) [\d-]+,)\s$", re.I),
}
BEFORE_GIVEN = re.compile(rf"(?<![\w’'-])((?:{PARTICLE} )?{WORD}) ?[ \xa0](?:{PARTICLE} )?$")
AFTER_GIVEN = re.compile(rf"[ \xa0](?:{PARTICLE} )?({WORD})")
LIST_BEFORE = re.compile(r"(?:[:,;]|\b(?:et|und|e|and|erteilt|contact))[ \xa0]$|\n$")
INITIAL = re.compile(rf"\b[{UP}]\.(?:-[{UP}]\.)?")
#: Two capitalized words that fill a place in a list or a line, as names do, and places.
PAIR = re.compile(rf"(?<![\w’'-]){WORD} {WORD}(?=[,.;\n]|$)")
PAIR_BEFORE = re.compile(r"(?:^|[:,;] |\b(?:et|e|und|and) |\n)$")
AFTER_TITLE = re.compile(rf"(?<!\w){TITLE}[ \xa0](?:{PARTICLE} )?$")
PERSON_AFTER = re.compile(r",\s(?:of|wohnhaft|née?|domicili)")


_PARTICLES = re.compile(PARTICLE)


def is_particle(word: str) -> bool:
    return _PARTICLES.fullmatch(word) is not None


def back(text: str, at: int, words: int) -> int:
    """The position so many words of the same line before ``at``."""
    for _ in range(words):
        while at and text[at - 1] in " \xa0":
            at -= 1
        while at and text[at - 1] not in " \xa0\n":
            at -= 1
    return at


def lowered(text: str) -> str:
    """Lower case, with as many characters."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@lru_cache(200_000)
def fold(token: str) -> str:
    t = unicodedata.normalize("NFKD", token.lower())
    return "".join(c for c in t if not unicodedata.combining(c))


def _ean(digits: str) -> bool:
    """Whether the last of thirteen digits is their check digit."""
    return len(digits) == 13 and (10 - sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits[:12])) % 10) % 10 == int(digits[12])


@lru_cache(1)
def _sure_finder() -> ahocorasick.Automaton:
    finder = ahocorasick.Automaton()
    for pattern, words in ((TITLED, TITLE_WORDS), (SIGNED, SIGNATURES)):
        for w in words:
            finder.add_word(w, (len(w), pattern))
    finder.make_automaton()
    return finder


def sure_tokens(text: str) -> list[str]:
    """The tokens of names in sure contexts: after a title or a signature."""
    out, seen = [], set()
    for last, (size, pattern) in _sure_finder().iter(lowered(text)):
        start = last + 1 - size
        if start not in seen and (m := pattern.match(text, start)):
            seen.add(start)
            words = [w for w in re.split(r"[ \xa0]", m[1]) if len(w) > 2]
            if len(words) > 1:
                out += words
    return out


class Detector:
    """Generators, features and the trees of each kind.

    ``given`` holds for each given name its share of the tokens in sure
    contexts, ``forms`` its spellings.
    """

    def __init__(self, given: dict[str, float], forms: frozenset[str] = frozenset()):
        self.given = given
        self.forms = frozenset(lowered(f) for f in forms or given)
        self.models: dict[str, Boosted] = {}
        self.finder = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "finder": None}

    def anchors(self, lower: str) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, kinds) of all words that candidates are found by, in one pass over the text."""
        if self.finder is None:
            words: dict[str, set[str]] = {}
            for kind, given in (("email", AT_WORDS), ("fr", STREETS), ("it", STREETS_IT), ("de", [w + " " for w in STREETS_DE]), ("en", [w.lower() for w in STREETS_EN]), ("title", TITLE_WORDS), ("name", self.forms)):
                for w in given:
                    words.setdefault(w, set()).add(kind)
            self.finder = ahocorasick.Automaton()
            for w, kinds in words.items():
                self.finder.add_word(w, (len(w), kinds))
            self.finder.make_automaton()
        for last, (size, kinds) in self.finder.iter(lower):
            yield last + 1 - size, last + 1, kinds

    def is_given(self, token: str) -> bool:
        return fold(token) in self.given

    def names(self, text: str, anchors: list[tuple[int, int]], titles: list[int]) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether a title is before it): names behind titles, pairs of a given name or initial and the word behind or before it, other pairs."""
        for m in (m for at in titles if (m := TITLED.match(text, at))):
            s, e = m.span(1)
            words = re.split(r"[ \xa0]", m[1])
            # a word after the name may begin the next sentence or title
            named = any(self.is_given(w) or w.endswith(".") or is_particle(w) for w in words)
            if len(words) > 1 and (IS_TITLE.match(words[-1]) or not named):
                e = s + len(m[1]) - len(words[-1]) - 1
            yield s, e, True
        found = [(s, e, False) for s, e in anchors if text[s].isupper() and not text[e : e + 1].isalnum() and text[e : e + 1] not in IN_WORD - {"."}]
        found += [(*m.span(), True) for m in INITIAL.finditer(text) if not IS_TITLE.match(m[0])]
        for s, e, init in sorted(found):
            if s and (text[s - 1] in "-_.’'@" or text[s - 1].isalnum()):
                continue
            if AFTER_TITLE.search(text, max(0, s - 24), s):
                continue  # found by its title
            before = BEFORE_GIVEN.search(text, back(text, s, 5), s)
            if before is not None and (IS_TITLE.match(before[1]) or self.is_given(before[1]) or AFTER_TITLE.search(text, max(0, before.start() - 24), before.start())):
                before = None
            after = AFTER_GIVEN.match(text, e)
            listed = before is not None and bool(LIST_BEFORE.search(text, max(0, before.start() - 10), before.start()) or before.start() == 0 or PERSON_AFTER.match(text, e))
            if listed or before is not None and after is None and not init:
                yield before.start(), e, False
            elif after is not None and not IS_TITLE.match(after[1]):
                yield s, after.end(), False
        for m in PAIR.finditer(text):
            if PAIR_BEFORE.search(text, max(0, m.start() - 5), m.start()) and not IS_TITLE.match(m[0].split(" ")[0]) and not any(map(self.is_given, m[0].split(" "))):
                yield *m.span(), False

    def name_features(self, text: str, s: int, e: int, title: bool) -> list[float]:
        """The title counts for single words only; of longer names the trees see nothing of what stands before."""
        words = [w for w in re.split(r"[ \xa0]", text[s:e]) if w and w != "la" and not is_particle(w)] or [text[s:e]]
        share = [self.given.get(fold(w), 0.0) for w in words]
        after = text[e : e + 1]
        return [
            float(title and len(words) == 1), share[0], share[-1], float(len(words)), float(words[0].endswith(".")), float(words[-1].endswith(".")),
            float(not after or after == "\n"), float(text[e : e + 2] == " ("), float(after == " " and text[e + 1 : e + 2].isdigit()),
            float(len(words[-1])), float(text[s:e].isupper()), float(words[-1].isupper() and len(words[-1]) > 2), float(min(map(len, words))), float("-" in words[0]),
        ]

    def name_label(self, text: str, s: int, e: int, title: bool) -> bool | None:
        before = text[max(0, s - 30) : s]
        if title or CUES["signed"].search(before) or PERSON_AFTER.match(text, e):
            return True
        return False if CUES["ground"].search(before) else None

    def addresses(self, text: str, anchors: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, pattern number) of addresses at words for a street, and of streets without number (-1)."""
        for s, e, kind in anchors:
            if kind in ("fr", "it"):
                if s and text[s - 1].isalnum():
                    continue
                if m := ADDRESS[0 if kind == "fr" else 2].match(text, s) or STREET_ONLY.match(text, s):
                    yield *m.span(), -1 if m.re is STREET_ONLY else 0 if kind == "fr" else 2
            elif kind == "de":
                word = s
                while word and (text[word - 1].isalnum() or text[word - 1] == "-"):
                    word -= 1
                m = next((m for lo in (back(text, word, 2), back(text, word, 1), word) if (m := ADDRESS[1].match(text, lo)) and m.start() <= s < m.end()), None)
                if m:
                    yield *m.span(), 1
                elif text[word : word + 1].isupper():
                    yield word, e - 1, -1
            elif text[s].isupper() and not text[e : e + 1].isalnum():
                if m := next((m for n in (4, 3, 2) if (m := ADDRESS[3].match(text, back(text, s, n))) and m.start() <= s < m.end()), None):
                    yield *m.span(), 3

    def emails(self, text: str, anchors: list[int]) -> Iterator[re.Match]:
        seen = -1
        for at in anchors:
            if at < seen:
                continue
            start = at - (at > 0 and text[at - 1].isspace())
            while start and (text[start - 1].isalnum() or text[start - 1] in IN_WORD):
                start -= 1
            while start < at and not (text[start].isalnum() or text[start] == "_"):
                start += 1
            if (m := EMAIL.match(text, start) or EMAIL.match(text, at)) and m.end() > at:
                seen = m.end()
                yield m

    def candidates(self, text: str, fitting: bool = False) -> Iterator[tuple[str, int, int, list[float], bool | None]]:
        """(kind, start, end, features, label); the label, by the words beside the candidate, is given only for fitting and None where they tell nothing."""
        ats, streets, given, titles = [], [], [], []
        for s, e, kinds in self.anchors(lowered(text)):
            for kind in kinds:
                if kind == "email":
                    ats.append(s)
                elif kind == "name":
                    given.append((s, e))
                elif kind == "title":
                    titles.append(s)
                else:
                    streets.append((s, e, kind))
        for m in self.emails(text, sorted(ats)):
            s, e, span = *m.span(), m[0]
            at = re.search(r"@|\b(?:at|arobase|chez|ät)\b", span, re.I)
            local, domain = span[: at.start()].rstrip(" ([{<"), span[at.end() :]
            parts = re.findall(r"[\w-]+", re.sub(r"\b(?:point|dot|punkt|punto)\b", " ", domain, flags=re.I))
            label = None
            if fitting:
                mention = at[0] == "@" and (at.start() == 0 or span[at.start() - 1].isspace()) and not domain[:1].isspace()
                label = False if mention else True if CUES["email"].search(text[max(0, s - 10) : s]) else None
            yield "email", s, e, [float(at[0] == "@"), float(len(parts)), float(len(local)), float(len(parts[-1]) if parts else 0), float("." in span), float("_" in span or "+" in span), float(span.count(" ")), float("\n" in span), float(any(x in span for x in "[({<")), float(text[e : e + 2] == " :")], label
        for m in DIGITS.finditer(text):
            span = m[0]
            if len(span) < 8:
                continue
            digits = "".join(filter(str.isdigit, span))
            n = len(digits)
            if n < 8 or n > 16:
                continue
            # a bracket around the whole number isn't part of it
            start = m.start() + (span[0] == "(" and not re.match(r"\(\+?\d{2,4}\)", span))
            features = self.number_features(text, m.start(), m.end(), span, digits)
            phone = social = None
            if fitting:
                before = text[max(0, m.start() - 24) : m.start()]
                cue = next((k for k in ("phone", "national_id", "number") if CUES[k].search(before)), None)
                phone, social = (cue == "phone", cue == "national_id") if cue else (None, None)
            yield "phone", start, m.end(), features, phone
            yield "national_id", m.start(), m.end(), features, social
        for m in LETTER_ID.finditer(text):
            s, e = m.span()
            if s and (text[s - 1].isalnum() or text[s - 1] in "-_"):
                continue
            label = None
            if fitting:
                before = text[max(0, s - 24) : s]
                label = True if CUES["national_id"].search(before) else False if CUES["number"].search(before) else None
            yield "national_id", s, e, self.number_features(text, s, e, m[0], "".join(filter(str.isdigit, m[0]))), label
        for s, e, pattern in self.addresses(text, streets):
            label = None
            if fitting:
                before = text[max(0, s - 20) : s]
                label = True if CUES["address"].search(before) else False if CUES["place"].search(before) else None
            span = text[s:e]
            last = span.rsplit("\n", 1)[-1]
            yield "address", s, e, [float(any(map(str.isdigit, span))), float(len(re.findall(r"\d+", span))), float(bool(re.search(r"\d{4} ", span))), float(e - s), float(span.count(" ")), float(len(last)), float(text[s - 1 : s] in ("", "\n")), float(text[max(0, s - 2) : s] == ": "), float(text[e : e + 1] in ("", "\n", ".", ",")), float(span[:1].isupper())], label
        for s, e, title in self.names(text, given, sorted(set(titles))):
            yield "name", s, e, self.name_features(text, s, e, title), self.name_label(text, s, e, title) if fitting else None
        if fitting:
            # a single word without a title isn't a name
            for m in re.finditer(rf"(?<=[a-zé] )({WORD})(?= [a-zà])", text):
                if not AFTER_TITLE.search(text, max(0, m.start() - 24), m.start()) and not self.is_given(m[0]):
                    yield "name", *m.span(), self.name_features(text, *m.span(), False), False

    def number_features(self, text: str, s: int, e: int, span: str, digits: str) -> list[float]:
        """Digits, grouping, signs and what stands at the sides."""
        groups = [float(len(g)) for g in re.findall(r"\d+", span)][:6]
        return [
            float(len(digits)), float("+" in span), float(digits[:2] == "00"), float(digits[0] == "0"), float(digits[:1] == "0" and digits[1:2] not in "0"), float(digits[:3] == "756"), float(_ean(digits)),
            float(span[0].isalpha()), float("." in span), float("/" in span), float(span.count("-")), float(span[-2:-1] == "-"), float("(" in span), float(" " in span or "\xa0" in span), float(len(groups)), *groups, *[0.0] * (6 - len(groups)),
            float(text[e : e + 2] == " :"), float(text[s - 1 : s] == "("),
        ]

    def fit(self, texts: list[str]) -> Detector:
        rows: dict[str, list] = {k: [] for k in KINDS}
        sizes: Counter = Counter()
        for text in texts:
            for kind, _, _, features, label in self.candidates(text, fitting=True):
                group = kind, label, kind == "name" and features[3] == 1
                if label is not None and sizes[group] < SAMPLE_CANDIDATES:
                    sizes[group] += 1
                    rows[kind].append((features, label))
        for kind, found in rows.items():
            x = np.array([f for f, _ in found], float)
            y = np.array([lab for _, lab in found], bool)
            self.models[kind] = Boosted().fit(x, y) if len(found) >= 20 else Boosted(trees=0).fit(np.zeros((2, 1)), np.array([True, True]))
        return self

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """For each text the kept spans, in order: start, end, kind, score."""
        spans = []
        for d, text in enumerate(texts):
            spans += [(d, *c[:4]) for c in self.candidates(text)]
        scores = np.zeros(len(spans))
        for kind in KINDS:
            rows = [i for i, c in enumerate(spans) if c[1] == kind]
            if rows and (model := self.models.get(kind)):
                scores[rows] = model.score(np.array([spans[i][4] for i in rows], float)) - model.threshold
        kept: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -(spans[i][3] - spans[i][2]) * (scores[i] >= 0), -scores[i], spans[i][2])):
            d, kind, s, e, _ = spans[i]
            if scores[i] >= 0 and all(e <= a or b <= s for a, b, _, _ in kept[d]):
                kept[d].append((s, e, kind, float(scores[i])))
        return [sorted(k) for k in kept]


def fit_detector(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Detector:
    """Given names from the sure contexts of all documents, and trees fitted on the candidates of at most ``sample`` documents."""
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null and text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(1).to_pylist():
                counts.update(sure_tokens(t))
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    tokens = cut(texts.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    folded = tokens.groupBy(fold_text(F.col("token")).alias("given")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("token")).alias("forms"))
    found = folded.where(F.col("n") >= F.greatest(F.lit(2), F.lit(total * GIVEN_SHARE))).collect()
    given, forms = {fold(r["given"]): r["n"] / total for r in found}, frozenset(f for r in found for f in r["forms"])
    n = texts.count()
    share = min(1.0, 1.3 * sample / max(n, 1))
    h = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30))
    rows = texts.where(h <= int(share * (1 << 30))).orderBy(h, "id").limit(sample).select("text").collect()
    return Detector(given, forms).fit([r[0] for r in rows])


def personal_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of personal information in each text.

    Gives ``doc_id``, ``kind``, ``start_pos`` (0-based character position),
    ``length`` and ``score``.  Null and empty texts have none.  All text is
    looked at, whatever its length; a text's spans don't overlap.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit_detector(documents, doc_id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = shared.value.find(part.column(1).to_pylist())
                flat = [(i, *s) for i, spans in enumerate(found) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([f[0] for f in flat], pa.int64())), pa.array([f[3] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] - f[1] for f in flat], pa.int32()), pa.array([f[4] for f in flat], pa.float64())],
                    ["doc_id", "kind", "start_pos", "length", "score"],
                )

    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    return spread(texts).mapInArrow(run, "doc_id long, kind string, start_pos int, length int, score double")


def personal_cases(documents: DataFrame) -> DataFrame:
    """p10_found: document, kind and position of each item."""
    return personal_spans(documents).select("doc_id", "kind", "start_pos").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with a typed placeholder, as [EMAIL], in place of each item and otherwise unchanged; null stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_detector(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found, out = shared.value.find([t or "" for t in texts]), []
            for text, spans in zip(texts, found):
                for s, e, kind, _ in reversed(spans):
                    text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(list(map(len, found)), pa.int32())], ["doc_id", "text", "items"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, items int")
