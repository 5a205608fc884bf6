import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicspark.llm import boilerplate, boosting, encoding, leaks, lines, mixing, names, neighbors, personal, queries, scans, splitting

META = "document_id string, title string, commune string, extra string"


def meta(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], META)


# ---- wrong decodings


def test_wrong_decodings(spark):
    good = ["Réponse à l’été", "Le crédit près de la forêt", "À quand la réserve ?", "L’école où l’on a créé le théâtre", "Jumelage avec São Bráulio"] * 30
    bad = ["Réponse à l’été".encode().decode("cp1252"), "Le crédit créé".encode("mac_roman").decode("cp1252"), "Le cr�dit", "L’école".encode().decode("cp1252").encode().decode("cp1252")]
    rows = [(f"g{i}", t, "Vérandes") for i, t in enumerate(good)] + [(f"b{i}", t, None) for i, t in enumerate(bad)] + [("n", None, None), ("e", "", ""), (None, bad[0], None), ("h", "cr&eacute;dit", "VERANDES")]
    got = {r.id: r for r in encoding.repair_fields(meta(spark, rows)).collect()}
    assert sorted(got) == ["b0", "b1", "b2", "b3"]
    assert got["b0"].repaired == "Réponse à l’été" and got["b1"].repaired == "Le crédit créé" and got["b2"].repaired == "Le crédit" and got["b3"].repaired == "L’école"
    assert {(r.document_id, r.field) for r in encoding.damaged_fields(meta(spark, rows)).collect()} == {(f"b{i}", "title") for i in range(4)}


def test_decodings_of_nothing(spark):
    assert encoding.damaged_fields(meta(spark, [])).count() == 0
    assert encoding.damaged_fields(meta(spark, [("a", None, "")])).count() == 0


# ---- splitting


def pieces(spark, text, limit=20, overlap=5):
    frame = spark.createDataFrame([(text,)], "t string")
    return frame.select(splitting.split_text(F.col("t"), limit, overlap)).first()[0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["un", "mot.", "deux,", "x\n", "y\n\n", "z ", "?"]), max_size=120))
def test_pieces_join_up(spark, words):
    text = " ".join(words)
    got = pieces(spark, text)
    assert "".join(p.piece[len(p.piece) - p.new_chars :] for p in got) == text
    assert all(len(p.piece.split()) <= 20 for p in got)
    for p in got[1:]:
        assert len(p.piece[: len(p.piece) - p.new_chars].split()) == 5


def test_pieces_of_odd_texts(spark):
    assert pieces(spark, None) is None and pieces(spark, "") == []
    assert [p.piece for p in pieces(spark, "a b")] == ["a b"]
    long = pieces(spark, "x" * 25_000 + " y" * 30)
    assert "".join(p.piece[len(p.piece) - p.new_chars :] for p in long) == "x" * 25_000 + " y" * 30
    got = pieces(spark, "a b c d e f g h i j k. " + "m " * 30)
    assert got[0].piece.endswith("k. ")


def test_oversized(spark):
    cols = "chunk_id string, document_id string, chunk_index int, section_title string, content string, loaded_at timestamp, piece_no string"
    rows = [("a", "d", 0, "t", "mot " * 451, None, "clash"), ("a", "d", 0, "t", "mot " * 451, None, "x"), ("b", "d", 1, None, "mot " * 451, None, None), ("c", "d", 2, None, "mot " * 450, None, None), (None, "d", 3, None, "mot " * 900, None, None), ("e", "d", 4, None, None, None, None)]
    frame = spark.createDataFrame(rows, cols)
    assert sorted(r[0] for r in splitting.oversized_chunks(frame).collect()) == ["a", "b"]
    assert {(r.piece_no, r.word_count) for r in splitting.split_chunks(frame).where("chunk_id = 'a'").collect()} == {(0, 450), (1, 61)}


# ---- names


def linked(spark, spellings):
    frame = spark.createDataFrame([(n, "x") for n in spellings], "name string, entity string")
    out = {}
    for r in names.link_names(frame).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return {frozenset(v) for v in out.values()}


def test_variants_of_names(spark):
    one = ["Xavier Perralasse"] * 5 + ["X. Perralasse", "PERRALASSE Xavier", "Perralasse, Xavier", "Xav Perralasse", "Xavier Pertalasse", "M. Xavier Perralasse (UVR)", "xavier perralasse"]
    two = ["Yvonne Perralasse"] * 3 + ["Y. Perralasse"]
    three = ["Marie-Claude Brossinoz"] * 2 + ["Mme M.-C. Brossinoz", "Marie Claude Brossinoz"]
    four = ["Association des habitants du vallon Durapet", "Ass. des habitants du vallon DURAPET", "Assoc. habitants vallon Durapet"]
    five = ["Ulysse Chamberoz"] * 2 + ["Ulysse Chamberoz-Berthosoz"]
    got = linked(spark, [*one, *two, *three, *four, *five, None, "", " ", "12"])
    assert got == {frozenset(x) for x in (one, two, three, four, five)}


def test_no_names(spark):
    assert linked(spark, []) == set()


def test_alignment():
    assert names.alignment(["brossalon", "p"], ["brossalon", "patricia"])[0] == names.INITIAL
    assert names.alignment(["brossalon", "p"], ["brossalon", "xavier"])[0] == float("inf")
    assert names.edits("abcd", "abdc") == 1 and names.edits("abc", "abcdef") == 3


# ---- scans


def test_noise(spark):
    clean = ("la commission demande au vice-président de garantir la transparence du crédit " * 3 + "\n") * 20
    noisy = "La cornmission demande la trans-\nparence du crédit au vice-\nprésident.\n\n4/12\n\nAubrény – motion N° 3-12 – Le crédit\nLa commission c0mmence"
    other = "Aubrény – motion N° 4-13 – La dette\nla commission"
    rows = [("c", clean, None), ("n", noisy, None), ("n", noisy, None), ("o", other, None), ("p", "[3]\n530’918\n2. Divers et imprévus", None), ("e", "", None), ("z", None, None), (None, noisy, None)]
    frame = spark.createDataFrame(rows, "chunk_id string, content string, loaded_at timestamp")
    got = {tuple(r) for r in scans.noise_kinds(frame).collect()}
    assert got == {("n", "hyphenation"), ("n", "characters"), ("n", "header"), ("n", "page_number"), ("o", "header"), ("p", "page_number")}
    text = {r.paragraph_no: r.text for r in scans.paragraphs(frame).where("chunk_id = 'n'").collect()}
    assert text[0] == "La commission demande la transparence du crédit au vice-président."


def test_every_frequent_form_is_a_reading(spark):
    long = "a" * 30 + "motion" * 4
    counts = [("tata", 90), ("lata", 80), ("tala", 70), ("lala", 60), ("lata1", 9), ("ta1a", 1), (long, 40), (long.replace("m", "rn", 1), 1)]
    frame = spark.createDataFrame([("w", *c) for c in counts], "kind string, key string, n long")
    got = {(r["word"], r["form"]): r["m"] for r in scans._readings(frame).collect()}
    assert got == {("ta1a", "tata"): 90, ("ta1a", "lata"): 80, ("ta1a", "tala"): 70, ("ta1a", "lala"): 60, (long.replace("m", "rn", 1), long): 40}
    # the fourth form is the one that stands behind the same word
    texts = [" ".join(f"un {w}" for w in ["tata"] * 90 + ["lata"] * 80 + ["tala"] * 70) + " du lala" * 60, "du ta1a"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    assert {tuple(r) for r in scans.noise_kinds(chunks).collect()} == {("c1", "characters")}
    assert scans.scan_lines(chunks).where("id = 'c1'").collect()[0]["lines"][0]["text"] == "du lala"


def test_no_scans(spark):
    assert scans.noise_kinds(spark.createDataFrame([], "chunk_id string, content string")).count() == 0


@pytest.mark.parametrize("line, yes", [("4/12", True), ("— 18 —", True), ("Page 4 sur 12", True), ("[3]", True), ("p. 6", True), ("Seite / page 4", True), ("7", True), ("530’918", False), ("2. Divers", False), ("", False), ("2024", False)])
def test_page_numbers(line, yes):
    assert lines.is_page_number(line) == yes


# ---- vectors


def test_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = (np.repeat(centres, 20, 0) + rng.normal(scale=0.4, size=(1200, 16))).astype(float)
    rows = [(f"v{i}", [float(a) for a in v * (1 + i % 3)]) for i, v in enumerate(x)] + [("v0", [float(a) for a in x[0]]), ("null", None), ("zero", [0.0] * 16), ("short", [1.0]), (None, [1.0] * 16)]
    got = {}
    for r in neighbors.nearest(spark.createDataFrame(rows, "k string, e array<float>"), "k", "e", 5, 16, leaf_rows=60).collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {f"v{i}": {f"v{j}" for j in np.argsort(-s[i])[:5]} for i in range(1200)}
    assert sum(len(want[k] & got.get(k, set())) for k in want) / 6000 >= 0.95
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())


def test_no_vectors(spark):
    assert neighbors.nearest(spark.createDataFrame([], "k string, e array<float>"), "k", "e").count() == 0
    assert neighbors.nearest(spark.createDataFrame([("a", [1.0] * 64)], "k string, e array<float>"), "k", "e").count() == 0


def test_tree_order():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    tree = neighbors.Tree.fit(x, 20)
    home = tree.home(x)
    order, cost = tree.visits(x, tree.leaves)
    assert (order[:, 0] == home).all() and all(len(set(r)) == tree.leaves for r in order)
    assert (np.diff(cost, axis=1) >= -1e-6).all()


# ---- repeated lines


def test_site_lines(spark):
    cols = "chunk_id string, document_id string, commune_key string, content string"
    share = ["Partager cette page par courriel", "PARTAGER CETTE PAGE PAR COURRIEL", "• Partager  cette page par courriel", "Partager cette page par…"]
    dated = [f"Mise à jour du {i} mars 2024 – signaler une erreur" for i in range(1, 5)]
    rows = [(f"c{i}", f"d{i}", "a", f"Texte propre numéro {'x' * i} du conseil.\n{share[i]}\n{dated[i]}\n3. Divers et imprévus\n4/12") for i in range(4)]
    rows += [("b", "db", "b", share[0]), ("c0", "d0", "a", rows[0][3]), ("n", None, "a", share[0]), ("m", "dm", None, None), ("e", "de", "a", "")]
    frame = spark.createDataFrame(rows, cols)
    assert {tuple(r) for r in boilerplate.site_lines(frame).collect()} == {(f"c{i}", n) for i in range(4) for n in (1, 2)}
    cleaned = {r.chunk_id: r.content for r in boilerplate.without_site_lines(frame).collect()}
    assert cleaned["c1"] == "Texte propre numéro x du conseil.\n3. Divers et imprévus\n4/12" and cleaned["b"] == share[0]
    assert boilerplate.site_lines(spark.createDataFrame([], cols)).count() == 0


def test_site_lines_met_once_in_a_partition(spark):
    cols = "chunk_id string, document_id string, commune_key string, content string"
    rows = [(f"c{i}", f"d{i}", "k", f"Texte {'abcdefgh'[i]} propre du document\nPartager cette page avec vos voisins") for i in range(4)]
    parts = [spark.createDataFrame([r], cols).coalesce(1) for r in rows]
    frame = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    got = boilerplate.repeated_lines(frame, "commune_key", "document_id", "chunk_id", "content")
    assert {(r.piece, r.line_no) for r in got.collect()} == {(f"c{i}", 1) for i in range(4)}


def test_summary_bound():
    random.seed(1)
    exact, summary = {}, boilerplate.Summary(20)
    for _ in range(5000):
        k = f"k{int(random.paretovariate(0.7))}"
        exact[k] = exact.get(k, 0) + 1
        summary.add(k)
    assert all(exact[k] - summary.off <= summary.counts.get(k, 0) <= exact[k] for k in exact)


# ---- leaks


def brute(docs, items, words):
    out = set()
    for d, t in docs:
        tw = leaks.re.findall(r"[^\W_]+", leaks._MARKS.sub("", leaks.unicodedata.normalize("NFKD", (t or "").lower())))
        grams = {tuple(tw[i : i + words]) for i in range(len(tw) - words + 1)}
        for i, *parts in items:
            for p in parts:
                pw = leaks.re.findall(r"[^\W_]+", leaks._MARKS.sub("", leaks.unicodedata.normalize("NFKD", (p or "").lower())))
                if any(tuple(pw[k : k + words]) in grams for k in range(len(pw) - words + 1)):
                    out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["été", "commission", "de", "la", "grève", "tableau", "l’eau", "rapport", "et", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=30)), " ".join(rng.choices(vocabulary, k=25))) for i in range(12)]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=40)
        if d % 2:
            part = rng.choice(items)[1 + d % 2 % 2].split()
            k = rng.randint(8, 20)
            s = rng.randint(0, len(part) - k)
            words[10:10] = part[s : s + k]
        text = " ".join(words)
        docs.append((d, text.upper().replace(" ", "\n") if d % 3 == 0 else text))
    docs += [(500, None), (501, "")]
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None, "")], "item_id long, question string, passage string"), words=12).select("doc_id", "item_id").collect()}
    assert got == brute(docs, items, 12) and got


def test_leaks_with_edits():
    base = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize"
    items = leaks.Items([(1, base)], 16, 2)
    texts = ["avant " + base.replace("huit", "huix") + " fin", base.replace("huit", "zzzzz"), "x " + base]
    assert sorted(items.find(texts, exact=False)) == [(0, 1, 16), (2, 1, 16)]
    assert items.find(texts) == [(2, 1, 16)]


def test_banded_distances_against_brute_force():
    rng = random.Random(5)

    def whole(a, b):
        """The least edits between a and any part of b."""
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    a, b = [], []
    for _ in range(300):
        x = [rng.choice(b"abc") for _ in range(rng.randint(5, 12))]
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(y))
            y[k : k + rng.choice([0, 1])] = [rng.choice(b"abc")] if rng.random() < 0.7 else []
        a.append(bytes(x))
        b.append(bytes([rng.choice(b"de") for _ in range(2)] + y + [100, 101]))
    got = leaks.banded_distances(a, b, 4, 2)
    assert [int(g) for g in got if g <= 2] and all(g == min(whole(x, y), 3) or (g == 3 and len(y) != len(x) + 4) for g, x, y in zip(got, a, b))


def test_leaks_cut_batches(monkeypatch):
    base = " ".join(f"mot{i}" for i in range(40))
    items = leaks.Items([(i, base) for i in range(6)], 16, 2)
    texts = [base, "autre", base.upper()]
    whole = sorted(items.find(texts))
    monkeypatch.setattr(leaks, "MOST_HITS", 50)
    assert sorted(items.find(texts)) == whole and len(whole) == 12


# ---- mixing


def test_mixing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, "un texte de quelques mots", "a" if i < 300 else "b", "clash") for i in range(400)] + [(900, None, "a", None), (901, "", "b", None)], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("m", "a", 1.0, None, 0.5), ("m", "b", 1.0, 1, 1.5), ("m", "none", 2.0, 3, 0.5), ("n", "b", 1.0, 2, 1.0), (None, "a", 1.0, 1, 1.0)], "mix_id string, source string, target_weight double, max_repeats int, budget_ratio double")
    mixed, report = mixing.mix_sources(docs, targets)
    rows = {(r.mix_id, r.source): r for r in report.collect()}
    assert rows["m", "none"].tokens == 0 and rows["m", "b"].rate == 1.0 and rows["n", "b"].rate == 2.0
    assert abs(rows["m", "a"].tokens / rows["m", "a"].wanted_tokens - 1) < 0.2
    copies = mixed.where("mix_id = 'n'").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies == 2 and mixed.agg(F.sum("tokens")).first()[0] == sum(r.tokens for r in rows.values())
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), targets)[0].collect()))
    assert mixing.mix_sources(docs.limit(0), targets)[0].count() == 0


# ---- personal information


PEOPLE = ["Isabelle Lavanasse", "Xavier Brossarot", "Zoé Mauvernidot", "Kilian Uldosenod"]


def corpus():
    out = []
    for i in range(160):
        p = PEOPLE[i % 4]
        out.append((i, f"Signé : {p}\nMadame {p}, né le 3 mai 2017, n° AVS 756.{1000 + i}.2345.6{i % 10}, demande un délai. Domicile : Rue de la Gravette {i}, 1{100 + i} Vérandes. Portable 079 0{10 + i % 80} 12 34. Copie à z.m{i}@post.example. La rue des Vernes sera fermée. Le code 4006381330 figure. Près de Clos Gouille, Plan Paluche."))
    return out


def test_personal_information(spark):
    docs = [*corpus(), (900, "Écrire à a.b [at] post [point] example ou (021) 063 52 68."), (901, None), (902, "")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kind string")
    spans = personal.personal_spans(frame).collect()
    text = dict(docs)
    of = lambda d: sorted((r.kind, text[d][r.start_pos : r.start_pos + r.length]) for r in spans if r.doc_id == d)
    p = PEOPLE[5 % 4]
    assert of(5) == sorted([("name", p), ("name", p), ("national_id", "756.1005.2345.65"), ("address", "Rue de la Gravette 5, 1105 Vérandes"), ("phone", "079 015 12 34"), ("email", "z.m5@post.example")])
    assert of(900) == [("email", "a.b [at] post [point] example"), ("phone", "(021) 063 52 68")]
    out = {r.doc_id: r.text for r in personal.redacted(frame).collect()}
    assert out[901] is None and out[902] == "" and "[NATIONAL_ID], demande un délai" in out[5] and "La rue des Vernes sera fermée" in out[5]


def test_personal_information_of_nothing(spark):
    assert personal.personal_cases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boosting_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.5)
    model = boosting.Boosted().fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) >= model.threshold) == y[1000:]).mean() > 0.9


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p7_found", "p8_found"])
def test_queries_run(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0


# ---- names: assignment and keys


def test_assignment_against_permutations():
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 5)
        cost = [[rng.choice([0.0, 0.5, 1.0, 7.0]) for _ in range(n + rng.randint(0, 1))] for _ in range(n)]
        cost = [row[: len(cost[0])] + [3.0] * (len(cost[0]) - len(row)) for row in cost]
        chosen = names.assignment(cost)
        least = min(sum(cost[i][j] for i, j in enumerate(order)) for order in permutations(range(len(cost[0])), n))
        assert len(set(chosen)) == n and abs(sum(cost[i][j] for i, j in enumerate(chosen)) - least) < 1e-9


def test_long_and_short_names(spark):
    long = "Association des parents pour la defense du lac bleu contre toute nouvelle marina privee"
    given = [long, long, long.replace("marina", "maruna"), "Li Wu", "Li Wu", "L. Wu", "Anna Berg"]
    frame = spark.createDataFrame([(n,) for n in given], "name string")
    got = {r["name"]: r["entity"] for r in names.link_names(frame).collect()}
    assert got[long] == got[long.replace("marina", "maruna")] and got["Li Wu"] == got["L. Wu"] != got["Anna Berg"]


def test_keys_of_linked_names_meet():
    rng = random.Random(4)
    given = ["jean", "marie", "christophe", "li", "anne-lise", "sebastien"]
    last = ["martin", "wu", "de kermonegny", "favre", "nervon"]
    forms = set()
    for _ in range(150):
        g, f = rng.choice(given), rng.choice(last)
        if rng.random() < 0.3:
            k = rng.randrange(len(f))
            f = f[:k] + rng.choice("xyz") + f[k + 1 :]
        g = rng.choice([g, g, g[:1] + ".", g[:4], g[:1] + g[2:] if len(g) > 5 else g])
        forms.add(" ".join(names.tokens(f"{g} {f}")))
    forms = sorted(forms)
    index = {f: names.keys(f) for f in forms}
    for a in forms:
        for b in forms:
            if a < b and names.alignment(a.split(" "), b.split(" "))[0] <= names.LIMIT:
                (sa, qa), (sb, qb) = index[a], index[b]
                assert sa & qb or sb & qa or qa & qb, (a, b)


# ---- lines of any length, and summaries that are handed on


def test_long_short_and_signed_lines(spark):
    notice = "Les informations publiées sur ce site le 12 mai 2020 " + "sont données sans garantie aucune et peuvent changer " * 12
    rows = []
    for d in range(8):
        own = "\n".join(f"Texte {chr(97 + d) * 5} du conseil {chr(98 + d) * 4}." for _ in range(2))
        rows.append(("a", f"d{d}", f"c{d}", f"{own}\n{notice.replace('12', str(d + 1))}\nPartager\n© 2024 Commune\nécole du village"))
    rows.append(("b", "x", "y", "Partager"))
    frame = spark.createDataFrame(rows, "s string, d string, p string, t string")
    got = {(r["piece"], r["line_no"]) for r in boilerplate.repeated_lines(frame, "s", "d", "p", "t").collect()}
    assert got == {(f"c{d}", i) for d in range(8) for i in (2, 3, 4)}


def test_summaries_are_handed_on(spark, monkeypatch):
    rows = [("a", f"d{d}", f"c{d}", f"Ligne commune à tous\nRien que {chr(97 + d % 20)}{chr(97 + d // 20)} ici") for d in range(60)]
    frame = spark.createDataFrame(rows, "s string, d string, p string, t string").repartition(6)
    whole = {tuple(r) for r in boilerplate.repeated_lines(frame, "s", "d", "p", "t").select("piece", "line_no").collect()}
    monkeypatch.setattr(boilerplate, "COUNTERS", (2, 4, None))
    monkeypatch.setattr(boilerplate, "CANDIDATES", 1)
    assert whole == {tuple(r) for r in boilerplate.repeated_lines(frame, "s", "d", "p", "t").select("piece", "line_no").collect()} == {(f"c{d}", 0) for d in range(60)}


def test_latest_version_is_cleaned(spark):
    import datetime

    rows = []
    for d in range(5):
        rows += [(f"d{d}#chunk-000", f"d{d}", "k", "Menu du site web\nancien texte", datetime.datetime(2020, 1, 1)), (f"d{d}#chunk-000", f"d{d}", "k", f"nouveau {'abcde'[d]}\nMenu du site web", datetime.datetime(2021, 1, 1))]
    frame = spark.createDataFrame(rows, "chunk_id string, document_id string, commune_key string, content string, loaded_at timestamp")
    got = {r["chunk_id"]: r["content"] for r in boilerplate.without_site_lines(frame).collect()}
    assert got == {f"d{d}#chunk-000": f"nouveau {'abcde'[d]}" for d in range(5)}


# ---- headers of any form, and forms that are joined instead of sent


def test_repeated_headers(spark):
    rows = [("d1#chunk-000", "Rapport au Conseil n° 12-2022\nDu texte ici"), ("d1#chunk-001", "suite\nRapport au Conseil n° 12-2022"), ("d2#chunk-000", "Avis n° 3\nfin"), ("d2#chunk-001", "Avis n° 3"), ("d3#chunk-000", "Avis n° 4"), (None, "x"), ("d4#chunk-000", None)]
    got = {tuple(r) for r in scans.repeated_headers(spark.createDataFrame(rows, "chunk_id string, content string")).collect()}
    assert got == {("d1#chunk-000", 0), ("d1#chunk-001", 1)}


def test_known_forms_are_joined(spark, data, monkeypatch):
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    sent = {tuple(r) for r in scans.noise_kinds(chunks).collect()}
    # a third of what there is, so everything is taken in blocks
    words = scans.scan_lines(chunks).selectExpr("explode(lines) as l").where("l.misread > 0").count()
    monkeypatch.setattr(scans, "ENTRIES", max(1, words // 3))
    assert sent == {tuple(r) for r in scans.noise_kinds(chunks).collect()} and sent


# ---- vectors: hot leaves, and visits that are widened


def test_hot_leaf_and_widening(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[:200] = x[0]
    rows = [(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id string, v array<float>").repartition(5)
    monkeypatch.setattr(neighbors, "SHARD_ROWS", 40)
    monkeypatch.setattr(neighbors, "FIRST_VISITS", 1)
    got = {}
    for r in neighbors.nearest(frame, "id", "v", 5, 8, leaf_rows=20).collect():
        got.setdefault(r["id"], []).append(r["similarity"])
    unit = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    exact = np.sort(sims, 1)[:, -5:]
    hit = sum(int((np.array(got.get(f"v{i:03}", [])) >= exact[i, 0] - 1e-4).sum()) for i in range(600))
    assert hit >= 0.93 * 3000 and all(min(got[f"v{i:03}"]) > 0.999 for i in range(200))


def test_vectors_meet_in_rounds(spark, monkeypatch):
    """What is shuffled at a time is bounded by the vectors, however many leaves they visit; nothing is lost for it."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(500, 8)))]
    frame = spark.createDataFrame(rows, "id string, v array<float>")
    run = lambda: {tuple(r)[:2] for r in neighbors.nearest(frame, "id", "v", 5, 8, leaf_rows=20).collect()}
    whole, sent = run(), []
    searched = neighbors._searched
    monkeypatch.setattr(neighbors, "_searched", lambda placed, shards, *a: sent.append(placed.count()) or searched(placed, shards, *a))
    monkeypatch.setattr(neighbors, "ROUND_COPIES", 1)
    monkeypatch.setattr(neighbors, "REGION_LEAVES", 3)
    monkeypatch.setattr(neighbors, "SHARD_ROWS", 50)
    assert run() == whole and len(whole) == 2500 and len(sent) > 3


def test_visits_by_region():
    import numpy as np

    order = np.array([[40, 3, 17, 2], [5, -1, -1, -1], [-1, -1, -1, -1], [16, 31, -1, -1]], np.int32)
    regions = lambda *p: [{"region": r, "leaves": v} for r, v in p]
    assert neighbors._by_region(order, 16).to_pylist() == [regions((0, [2, 3]), (1, [17]), (2, [40])), regions((0, [5])), [], regions((1, [16, 31]))]
    assert neighbors._by_region(order[:0], 16).to_pylist() == [] and neighbors._by_region(order[2:3], 16).to_pylist() == [[]]
