"""Variant spellings of the names of persons and associations.

Names are cut into tokens without titles, party marks, case and accents.  A
symmetric-delete index finds tokens at a small edit distance.  Two names are
candidates if one token is the same and another one is near, or one is near
and another one begins alike or is an initial; the total cost that links two
names permits no more than one edit, so nothing else can be linked.  They are
aligned by an optimal assignment of their tokens, where initials, nicknames,
abbreviations and left-out parts are permitted at a price.  Each spelling then points to its
best more frequent partner, and spellings that lead to the same root are one
entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import cut

#: Titles before names (fixed values).
TITLES = {"m", "mm", "mr", "mme", "mmes", "mlle", "monsieur", "madame", "mademoiselle", "herr", "frau", "dr", "me", "syndic", "prof"}
#: Words that say little in the name of an association (fixed values).
SMALL = {"de", "du", "des", "d", "la", "le", "les", "l", "pour", "en", "et", "a", "au", "aux", "un", "une"}
#: Given names that begin a double given name (fixed values).
DOUBLE = {"jean", "marie", "anne", "pierre", "rose", "charles", "louis", "luc", "paul"}
#: Nicknames that aren't the beginning of the given name they stand for (fixed values).
NICKNAMES = {"lolo": "laurence", "mina": "wilhelmine", "ginou": "genevieve", "lena": "helene", "titi": "thierry", "babette": "elisabeth", "lili": "elisabeth", "fanny": "stephanie", "mimi": "mireille", "jo": "joseph", "gege": "gerard", "dede": "andre", "bob": "robert", "kiki": "christine", "jef": "jean-francois", "fred": "frederic", "manu": "emmanuel", "lise": "anne-lise", "bea": "beatrice", "cathy": "catherine", "nico": "nicolas", "seb": "sebastien", "zaza": "isabelle", "tine": "martine", "nathou": "nathalie"}
#: Words that begin the name of an association, with their abbreviations (fixed values).
KINDS = {"gpt": "groupement", "grpt": "groupement", "ass": "association", "assoc": "association", "soc": "societe", "ste": "societe", "coll": "collectif", "fond": "fondation", "fed": "federation", "cie": "compagnie", "comm": "commission", "grpe": "groupe", "gr": "groupe", "com": "comite", "synd": "syndicat"}
#: Costs of the alignment, and the largest total that links two names.
EDIT, INITIAL, NICK, DROPPED, LIMIT = 1.0, 0.6, 0.5, 0.6, 1.7


@lru_cache(100_000)
def fold(text: str) -> str:
    """Lower case without accents; ligatures become two letters."""
    plain = text.lower().replace("œ", "oe").replace("æ", "ae").replace("ß", "ss").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))


def tokens(name: str) -> list[str]:
    """The tokens of a name, sorted: an initial is its letter(s), a double given name keeps its hyphen."""
    plain = re.sub(r"\(.*?\)", " ", fold(name))
    plain = re.sub(r"\b(\w)\.-(\w)\.", r"\1-\2", plain)
    words = [w.strip("-'.") for w in re.split(r"[\s,.;:/]+|(?<=\bd)'|(?<=\bl)'", plain)]
    words = [w for w in words if w]
    # "M." before a single word is an initial
    while len(words) > 1 and words[0] in TITLES and not (words[0] == "m" and len(words) == 2):
        words.pop(0)
    for i in range(len(words) - 1):
        if len(words) > 2 and words[i] in DOUBLE and words[i + 1] not in SMALL:
            words[i : i + 2] = [f"{words[i]}-{words[i + 1]}"]
            break
    if words and (words[0] in KINDS or words[0] in KINDS.values()):
        words = [KINDS.get(words[0], words[0])] + [w for w in words[1:] if w not in SMALL]
    return sorted(words)


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; 3 if more than 2."""
    if abs(len(a) - len(b)) > 2:
        return 3
    two, one, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, one, row = one, row, [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
    return min(row[-1], 3)


def is_initial(t: str) -> bool:
    return len(t) == 1 or (len(t) == 3 and t[1] == "-")


def initials(t: str) -> str:
    return "-".join(p[:1] for p in t.split("-") if p)


def deletes(t: str) -> set[str]:
    """The token and what is left of it with one character deleted; the index key of edit distance 1."""
    return {t} | ({t[:i] + t[i + 1 :] for i in range(len(t))} if len(t) >= 4 else set())


@lru_cache(200_000)
def token_cost(a: str, b: str) -> float:
    """The price of taking one token for the other; infinite if they can't be the same."""
    if a == b:
        return 0.0
    if a.replace("-", "") == b.replace("-", ""):
        return 0.1
    if is_initial(a) or is_initial(b):
        short, long = (a, b) if is_initial(a) else (b, a)
        if is_initial(long):
            return float("inf")
        return INITIAL if initials(long) == short or (len(short) == 1 and "-" not in long and long[:1] == short) else float("inf")
    short, long = sorted((a, b), key=len)
    if "-" in long and "-" not in short and len(short) >= 4:
        # a double name of which one part is left out
        first = long.split("-")[0]
        return DROPPED if first == short else EDIT + DROPPED if len(first) >= 5 and edits(first, short) <= 1 else float("inf")
    if NICKNAMES.get(short) == long:
        return NICK
    if len(short) >= 3 and len(long) - len(short) >= 2 and long.startswith(short):
        return NICK
    if min(len(a), len(b)) >= 4 and edits(a, b) <= 1:
        return EDIT
    return float("inf")


def assignment(cost: list[list[float]]) -> list[int]:
    """For each row its column in the assignment with the least total cost; no more rows than columns.

    Rows are added one at a time along the shortest augmenting path, with
    potentials that keep all reduced costs from being negative.
    """
    rows, columns = len(cost), len(cost[0])
    row_price, column_price = [0.0] * rows, [0.0] * columns
    owner = [-1] * columns
    for new in range(rows):
        distance, parent, done = [float("inf")] * columns, [-1] * columns, [False] * columns
        row, at, reached = new, -1, 0.0
        while True:
            nearest = -1
            for j in range(columns):
                if done[j]:
                    continue
                d = reached + cost[row][j] - row_price[row] - column_price[j]
                if d < distance[j]:
                    distance[j], parent[j] = d, at
                if nearest < 0 or distance[j] < distance[nearest]:
                    nearest = j
            reached, at = distance[nearest], nearest
            done[at] = True
            if owner[at] < 0:
                break
            row = owner[at]
        for j in range(columns):
            if done[j]:
                if owner[j] >= 0:
                    row_price[owner[j]] += reached - distance[j]
                column_price[j] += distance[j] - reached
        row_price[new] += reached
        while at >= 0:
            before = parent[at]
            owner[at] = owner[before] if before >= 0 else new
            at = before
    out = [-1] * rows
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


#: Stands for an infinite price in an assignment.
_NEVER = 1e6


def alignment(a: list[str], b: list[str]) -> tuple[float, int]:
    """The least cost of an assignment of the tokens of a to those of b, and how many full tokens agree.

    A token without partner costs ``2 * DROPPED``; so no more than one may be
    left out.  At least one token longer than an initial has to agree up to an
    edit.  Names may have any number of tokens.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) - len(a) > 1:
        return float("inf"), 0
    prices = [[min(token_cost(x, y), _NEVER) for y in b] for x in a]
    best, agree = float("inf"), 0
    full = [[not is_initial(x) and not is_initial(y) and c < _NEVER and c != NICK and len(x) > 1 for y, c in zip(b, row)] for x, row in zip(a, prices)]
    chosen = assignment(prices)
    # where the cheapest assignment has no full pair, each full pair is tried as a fixed one
    for fixed in [None] if any(full[i][j] for i, j in enumerate(chosen)) else [(i, j) for i in range(len(a)) for j in range(len(b)) if full[i][j]]:
        if fixed:
            chosen = assignment([[c if (i == fixed[0]) == (j == fixed[1]) else _NEVER for j, c in enumerate(row)] for i, row in enumerate(prices)])
        cost = DROPPED * (len(b) - len(a)) * 2 + sum(prices[i][j] for i, j in enumerate(chosen))
        n = sum(full[i][j] for i, j in enumerate(chosen))
        if n and cost < best:
            best, agree = cost, n
    return (best, agree) if best < _NEVER else (float("inf"), 0)


def _forms(names: DataFrame) -> DataFrame:
    """One row for each spelling up to case, accents, order, titles and party."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toks = [tokens(n) for n in batch["name"]]
            yield pd.DataFrame({"name": batch["name"], "n": batch["n"], "places": batch["places"], "form": [" ".join(t) for t in toks]})

    return names.mapInPandas(run, "name string, n long, places array<string>, form string")


def keys(form: str) -> tuple[set[str], set[str]]:
    """The index of a form: the keys it is stored under, and those it asks for.

    Of two forms that can be linked, one token is the same in both or one edit
    away, and of another one the same is true, or it begins alike (an
    abbreviation, a nickname, a double name), or it is an initial.  Each way
    has keys of its own, so a group holds forms that agree in two tokens; only
    forms with an initial ask for "one token and an initial", where all forms
    are stored.  The word that begins the names of associations is no token to
    be found by.
    """
    words = form.split(" ")
    stored, asked = set(), set()
    solid = [w for w in words if not is_initial(w) and w not in KINDS.values()] or [w for w in words if not is_initial(w)]
    for i, w in enumerate(solid):
        near = deletes(w) | (deletes(w.split("-")[0]) if "-" in w else set())
        rest = solid[:i] + solid[i + 1 :]
        short = [x for x in words if is_initial(x)]
        for other in rest:
            begins = NICKNAMES.get(other, other)
            # equal and near, near and alike
            both = {f"2 {w} {d}" for d in deletes(other)} | {f"3 {d} {x[:3]}" for d in near for x in {begins, other}}
            stored |= both
            asked |= both
            stored |= {f"1 {d} {x[:1]}" for d in near for x in {begins, other, *other.split("-")[:1]}}
        for x in short:
            own = {f"1 {d} {x[:1]}" for d in near}
            stored |= own
            asked |= own
        if len(words) <= 2:
            # a token alone, and the one that is left when the other one is left out
            alone = {f"0 {d}" for d in near}
            stored |= alone
            asked |= alone if len(words) == 1 else set()
    return stored, asked


def _keys(forms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for form in batch["form"]:
                stored, asked = keys(form)
                out += [(form, k, k in asked) for k in stored | asked]
            yield pd.DataFrame(out, columns=["form", "key", "asks"])

    return forms.select("form").mapInPandas(run, "form string, key string, asks boolean")


def link_names(mentions: DataFrame, name: str = "name", place: str | None = None) -> DataFrame:
    """Each spelling with the entity it denotes.

    Gives ``name`` (exact strings), ``entity`` (the most frequent spelling's
    form) and ``mentions``.  Nulls, blank names and names without letters take
    no part.  ``place`` names a column that helps to decide between entities
    that a spelling with initials could stand for: the one that shares most
    places wins, then the more frequent one.  A form is linked to the best
    partner that is more frequent (ties: longer, then first in order), so
    links form trees and no chain of typing errors joins two frequent forms.
    """
    where = F.col(place).cast("string") if place else F.lit(None).cast("string")
    names = (
        mentions.select(F.col(name).cast("string").alias("name"), where.alias("place")).where(F.col("name").rlike(r"\p{L}"))
        .groupBy("name").agg(F.count("*").alias("n"), F.collect_set("place").alias("places"))
    )
    spelled = cut(_forms(names).where("form <> ''"))
    forms = spelled.groupBy("form").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    index = _keys(forms)
    asking = index.where("asks").select("key", F.col("form").alias("a"))
    met = asking.join(index.select("key", F.col("form").alias("b"), "asks"), "key").where("a <> b and (not asks or a < b)").select("a", "b").distinct()
    pairs = met.select(F.explode(F.array(F.struct(F.col("a").alias("form"), F.col("b").alias("other")), F.struct(F.col("b").alias("form"), F.col("a").alias("other")))).alias("p")).select("p.*").distinct()
    candidates = (
        pairs.join(forms.alias("f"), "form").join(forms.select(F.col("form").alias("other"), F.col("n").alias("m"), F.col("places").alias("theirs")).alias("o"), "other")
        .select("form", "other", "n", "m", F.size(F.array_intersect("places", "theirs")).alias("shared"))
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [alignment(a.split(" "), b.split(" ")) for a, b in zip(batch["form"], batch["other"])]
            batch["cost"] = [f[0] for f in found]
            yield batch[batch["cost"] <= LIMIT]

    scored = candidates.mapInPandas(score, "form string, other string, n long, m long, shared int, cost double")
    count_initials = lambda c: F.size(F.filter(F.split(F.col(c), " "), lambda t: (F.length(t) == 1) | t.rlike("^.-.$")))
    better = (
        (count_initials("other") < count_initials("form"))
        | ((count_initials("other") == count_initials("form")) & ((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("form")))))
    )
    best = Window.partitionBy("form").orderBy(
        F.floor(F.col("cost")), F.col("shared").desc(), "cost", F.col("m").desc(), "other"
    )
    parents = scored.where(better).withColumn("r", F.row_number().over(best)).where("r = 1").select("form", F.col("other").alias("parent"))
    tree = cut(forms.select("form").join(parents, "form", "left").select("form", F.coalesce("parent", "form").alias("root")))
    for _ in range(30):
        up = tree.select(F.col("form").alias("root"), F.col("root").alias("next"))
        following = cut(tree.join(up, "root").select("form", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        tree = following.select("form", "root")
        if following.where("moved").isEmpty():
            break
    return spelled.join(tree, "form").select("name", F.col("root").alias("entity"), F.col("n").alias("mentions"))


def author_entities(metadata: DataFrame) -> DataFrame:
    """The authors' spellings and their entities; rows delivered twice count once."""
    authors = metadata.select("document_id", "commune_key", F.explode("authors").alias("a")).select("document_id", "commune_key", F.col("a.name").alias("name")).distinct()
    return link_names(authors, "name", "commune_key")


def same_authors(metadata: DataFrame) -> DataFrame:
    """p3_found: all pairs of spellings of one author."""
    linked = author_entities(metadata).select("name", "entity")
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
