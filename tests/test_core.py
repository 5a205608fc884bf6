import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicspark.functions import dates, text
from civicspark.operators import dedup, linkage, objects, quality, retrieval, segment, store
from civicspark.plans import question
from civicspark.sources import html, providers, readers
from civicspark.streaming import changes


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("f, given_, wanted", [
    (text.compact, " a   b\n", "a b"), (text.fold, "É́àÇ", "eac"), (text.normalized_words, "L’École, 2e étage", "l ecole 2e etage"), (text.slug, "Été à Nyon!", "ete-a-nyon"),
    (text.strip_tags, "<p>caf&eacute; <b>&amp; th&eacute;</b></p>", "café & thé"), (text.word_count, "a b  c", 3), (text.lexical_word_count, "l'eau -- dit-on", 2), (text.page_markers, "a 3 | 12 b", 1),
    (text.without_page_lines, "a\nPage 3 sur 4\n\n\n\nb", "a\n\nb"), (text.basename, "https://x.ch/a/b.pdf?c=d", "b.pdf"), (text.response_reference, "Réponse municipale N° 3-2024", "RI 03/2024"),
    (text.object_type, "Motion sur une interpellation", "interpellation"), (text.valid_email, " A@b.ch ", True), (text.valid_email, None, False), (text.reread, "crÃ©dit", "crédit"), (text.reread, "lâ€™eau", "l’eau"), (text.reread, "été", "été"),
    (dates.long_date, "Le 1er août 2024, puis le 3 mai 2025", "2024-08-01"), (dates.last_long_date, "Le 1er août 2024, puis le 3 mai 2025", "2025-05-03"), (dates.long_date, "31 février 2024", None), (dates.swiss_date, "3.5.2024", "2024-05-03"),
    (dates.iso_in_name, "x_2024-05-03_y.pdf", "2024-05-03"), (dates.french_date, "2024-08-01", "1er août 2024"), (dates.french_date, "autre", "autre"), (dates.amounts, "CHF 1’250.50 et CHF 3", [1250.5, 3.0]), (dates.url_year, "https://x/2023/a.pdf", "2023"),
])
def test_expressions(spark, f, given_, wanted):
    assert one(spark, f, given_) == wanted


def test_expressions_of_null(spark):
    for f in (text.compact, text.fold, text.slug, text.strip_tags, text.clean_text, text.response_reference, dates.long_date, dates.french_date, dates.content_hash):
        assert one(spark, f, None) is None


def test_keyed_fingerprint(spark):
    import hashlib
    import hmac

    for key in ("k", "k" * 80):
        assert one(spark, lambda c, k=key: dates.hmac_sha256(c, k), "été") == hmac.new(key.encode(), "été".encode(), hashlib.sha256).hexdigest()


def test_total_and_article_order(spark):
    assert one(spark, lambda c: dates.signed_total(c, "résultat"), "Résultat : déficit de 2,5 millions") == -2.5e6
    order = spark.createDataFrame([("13",), ("12ter",), ("12",), ("12bis",)], "a string").orderBy(dates.article_key(F.col("a"))).collect()
    assert [r[0] for r in order] == ["12", "12bis", "12ter", "13"]


def test_enumeration_and_phrases(spark):
    assert [one(spark, text.listed, v, "array<string>") for v in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a et b", "a, b et c"]
    assert one(spark, text.quoted_phrases, "dit « le plan de mobilité » et \"le budget 2024\"") == ["le budget 2024", "le plan de mobilité"]
    assert one(spark, text.capitalized_keywords, "Où est Roussy dans la Commune ?") == ["Roussy"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 1500), st.integers(5, 60))
def test_windows_cover_the_words(spark, n, size):
    overlap = size // 3
    words = [str(i) for i in range(n)]
    got = [w.split(" ") for w in one(spark, lambda c: segment.windows(c, size, overlap), words, "array<string>")]
    assert len(got) == (0 if n == 0 else 1 if n <= size else math.ceil((n - overlap) / (size - overlap)))
    assert [w for i, g in enumerate(got) for w in (g if i == 0 else g[overlap:])] == words
    assert all(len(g) <= size for g in got)


def test_source_windows_keep_lines(spark):
    assert one(spark, lambda c: segment.source_windows(c, 3, 1), " a\nb  c\td e ") == ["a\nb  c", "c\td e"]
    assert one(spark, lambda c: segment.short_kept_windows(c, 3, 1), " a\nb ") == [" a\nb "]


def test_sections(spark):
    body = "Question " + "mot " * 70 + "\nRÉPONSE MUNICIPALE N° 3/2025\nOui.\nRÉPONSE MUNICIPALE ORALE\nNon."
    got = one(spark, segment.response_sections, body)
    assert [(s.component, s.section_title, s.response_number) for s in got] == [("interpellation_text", "Interpellation", None), ("municipal_response", "Réponse municipale 3/2025", "3/2025"), ("municipal_response", "Réponse municipale orale", None)]
    assert one(spark, lambda c: segment.spaced(c, 10), [1, 5, 12, 13, 30], "array<int>") == [1, 12, 30]
    assert one(spark, lambda c: segment.positions(c, "x."), "abx.x.c x.") == [3, 5, 9] and one(spark, lambda c: segment.positions(c, "x."), "") == []
    assert one(spark, lambda c: segment.last_section(c, "Début", "Fin"), "Début x\nDébut y\nFin z") == "Début y"


def test_dedup_and_interleave(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 3, 0.7), ("b", 1, 0.6)], "g string, id int, score double")
    got = [(r.g, r.id) for r in dedup.interleave(df, "g", [F.desc("score")], "id", 10).orderBy("place").collect()]
    assert got == [("a", 1), ("b", 3), ("a", 2)]
    best = dedup.best_and_margin(df, "g", "id", "score").orderBy("g").collect()
    assert [(r.g, r.id, round(r.margin, 6)) for r in best] == [("a", 1, 0.1), ("b", 3, 0.1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "n")], "k int, v string, first string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z"), (None, "m", "m")], "k int, v string, first string")
    once = store.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, "a", "x"), (2, None, "y"), (3, "c", "z"), (None, "m", "m")], key=str)
    assert sorted(map(tuple, store.upsert(once, new, ["k"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    merged = {r.k: (r.v, r.first) for r in store.upsert_coalesced(old.where("k is not null"), new.where("k is not null"), "k", ["first"]).collect()}
    assert merged == {1: ("a", "x"), 2: ("b", "y"), 3: ("c", "z")}


def test_versioned_table(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3))
    table.append(spark.range(3, 4))
    assert table.read().count() == 4

    def refuse(_):
        raise ValueError

    with pytest.raises(ValueError):
        table.replace(spark.range(9), refuse)
    assert table.read().count() == 4


def test_change_log(spark):
    cols = "pdf_url string, title string, content_length long, last_modified string, etag string"
    known = spark.createDataFrame([("a", "t", 1, "m", "e"), ("b", "t", 1, "m", "e"), ("c", "t", 1, "m", "e")], cols)
    listed = spark.createDataFrame([("a", "T", 2, "m", "e"), ("b", "t", None, None, None), ("d", "t", 1, "m", "e")], cols)
    assert sorted(map(tuple, store.change_log(known, listed).collect())) == [("a", "content_changed"), ("a", "renamed"), ("d", "new")]


def test_matched_entries(spark):
    own = spark.createDataFrame([("a",), ("b",), ("c",)], "object_id string")
    entries = spark.createDataFrame([("a", 0, "2", None, None), ("a", 1, None, None, None), ("b", 0, "9", None, None)], "object_id string, entry_no int, response_number string, adoption_date string, entry_date string")
    links = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("c", 0, "gone"), ("c", 1, "x")], "object_id string, position int, response_id string")
    responses = spark.createDataFrame([("x", ["1"]), ("y", ["2"]), ("z", None)], "response_id string, numbers array<string>")
    got = {(r.object_id, r.entry_no): (r.response_number, r.response_id) for r in objects.matched_entries(own, entries, links, responses).collect()}
    # the only link stands in where the number isn't found; c has the entries of its response
    assert got == {("a", 0): ("2", "y"), ("a", 1): (None, "x"), ("b", 0): ("9", "y"), ("c", 0): ("1", "x")}


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    got = retrieval.vector_search(df, [1.0, 0.0], 5).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("a", 1.0), ("e", 0.707107)]


def test_fusion_and_expansion(spark):
    f = lambda rows: spark.createDataFrame(rows, "chunk_id string, document_id string, score double")
    fused = retrieval.fuse(f([("c1", "d1", 1.0)]), f([("c1", "d1", 0.9), ("c3", "d2", 0.9), ("c4", "d2", 0.9)]), f([("c3", "d2", 0.8), ("c9", "d9", 0.5)]), 4)
    assert [(r.place, r.chunk_id) for r in fused.orderBy("place").collect()] == [(1, "c1"), (2, "c3"), (3, "c9")]
    chunks = spark.createDataFrame([(f"x{i}", "d1") for i in range(20)] + [("c3", "d2"), ("c4", "d2")], "chunk_id string, document_id string")
    grown = {r.chunk_id for r in retrieval.expand_small_documents(fused, chunks, 2).collect()}
    assert grown == {"c1", "c3", "c4", "c9"}
    assert [r.chunk_id for r in retrieval.rerank_filled(fused, ["c9"], 2).collect()] == ["c9", "c1"]
    assert not retrieval.weak(fused)


def test_title_links(spark):
    left = spark.createDataFrame([("r1", "Réponse à l’interpellation « Le captage des sources »"), ("r2", None), ("r3", "")], "document_id string, title string")
    right = spark.createDataFrame([("o1", "Le captage des sources"), ("o2", "La dette communale"), ("o3", None)], "document_id string, title string")
    got = linkage.link_by_title(left, right).collect()
    assert [(r.l, r.r, r.score, r.tier) for r in got] == [("r1", "o1", 1.0, "exact")]


def test_pairs_of_common_tokens(spark):
    # every token is on most of 300 right rows; the one pair wanted shares two of them
    left = spark.createDataFrame([("a", ["pour", "date", "seul"]), ("b", ["pour"]), ("c", ["rien", "date"]), ("d", None)], "id string, t array<string>")
    right = spark.createDataFrame([(f"r{i:03}", ["pour", "date"] if i == 7 else ["pour" if i % 2 else "date", "x"]) for i in range(300)], "id string, t array<string>")
    pairs = linkage.candidate_pairs(left, right, "id", "id", "t", "t", lambda _: F.lit(2))
    assert [tuple(r) for r in linkage.overlap_join(pairs).collect()] == [("a", "r007", 2)]
    hot = linkage.salted_join(spark.createDataFrame([(f"a{i}", "x") for i in range(20)], "l string, token string"), spark.createDataFrame([(f"b{i}", "x") for i in range(30)], "r string, token string"), 7)
    assert hot.count() == hot.distinct().count() == 600


def test_containment(spark):
    left = spark.createDataFrame([("a", "la garderie"), ("b", "quel avenir pour la garderie des petits"), ("c", "arde"), ("d", ""), ("e", None), ("f", "le bus de nuit"), ("g", "quel")], "id string, k string")
    right = spark.createDataFrame([("r1", "quel avenir pour la garderie"), ("r2", "belle garderies"), ("r3", "le bus de nuits"), ("r4", "bus"), ("r5", "")], "id string, k string")
    got = {tuple(r) for r in linkage.contained_join(left, right, "id", "id", "k", "k").collect()}
    a, b = [[tuple(r) for r in df.collect() if r.k] for df in (left, right)]
    assert got == {(i, j) for i, x in a for j, y in b if x in y or y in x} and {("a", "r1"), ("c", "r2"), ("f", "r4")} <= got


def test_response_match(spark):
    left = spark.createDataFrame([("a", "Les camps de ski"), ("b", "Garderie"), ("c", "Bus de nuit et vélos au bourg"), ("d", None)], "l string, title string")
    right = spark.createDataFrame([("r1", "A quand les camps de ski ?"), ("r2", "Rapport. La garderie, puis un bus la nuit, des vélos et le bourg"), ("r3", "autre"), ("r4", None)], "r string, text string")
    got = {tuple(r) for r in linkage.response_match(left, right).collect()}
    assert got == {("a", "r1", 2, 1.0, True), ("b", "r2", 1, 1.0, True), ("c", "r2", 4, 1.0, False)}


def test_response_match_against_all_pairs(spark, monkeypatch):
    """In blocks, over two pairs of columns, without a shuffle of the pairs."""
    import random

    monkeypatch.setattr(linkage, "TITLES", 9)
    monkeypatch.setattr(linkage, "TEXTS", 7)
    monkeypatch.setattr(linkage, "PAIRS", 5)
    rng = random.Random(3)
    words = "bus nuit bourg lac de la un velo velos garderie ecole rue".split()
    text_of = lambda least, most: None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(least, most)))
    left = [(f"l{i:02}", text_of(0, 6), text_of(1, 3)) for i in range(40)] + [("l40", "us", "elo"), ("l41", "lo garderie", ""), ("l42", "o un v", None), (None, "bus", "bus")]
    right = [(f"r{i:02}", text_of(0, 12), text_of(0, 4)) for i in range(30)] + [(None, "bus nuit", "bus")]

    def match(title, text):
        own = {w for w in (title or "").split() if len(w) > 2 and w not in linkage.TITLE_STOPWORDS}
        shared = len(own & set((text or "").split()))
        exact = bool(title) and title in (text or "")
        covered = len(own) > 1 and shared >= min(4, len(own)) and shared / len(own) >= 0.72
        return (shared, round(shared / max(1, len(own)), 6), exact) if exact or covered else None

    want = {}
    for a, *titles in left:
        for b, *texts in right:
            if a and b and (found := [m for m in map(match, titles, texts) if m]):
                want[a, b] = tuple(map(max, zip(*found)))
    frames = spark.createDataFrame(left, "l string, x string, y string"), spark.createDataFrame(right, "r string, u string, v string")
    pairs = linkage.response_match(*frames, (("x", "u"), ("y", "v")))
    got = pairs.collect()
    assert {(r["l"], r["r"]): tuple(r)[2:] for r in got} == want and len(got) == len(want) > 100
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_audit_helpers(spark):
    with pytest.raises(ValueError):
        quality.one_row(spark.range(2), "regulation")
    got = quality.compare_records(spark.createDataFrame([(1, "a ", None)], "k int, f string, g string"), spark.createDataFrame([(1, "a", "b"), (2, None, None)], "k int, f string, g string"), "k", ["f", "g"])
    assert {tuple(r) for r in got.collect()} == {(1, "f", "identical"), (1, "g", "only_new"), (2, "f", "both_missing"), (2, "g", "both_missing")}


def test_catalog_claims_only_what_is_built():
    """Codes that were once claimed without an operator: their queries have to call it."""
    import inspect

    from civicspark import queries  # noqa: F401  registers all queries
    from civicspark.catalog import CATALOG

    calls = {"G6": "segment.motion_sections", "G7": "segment.postulate_sections", "G12": "segment.last_section", "G14": "segment.embedding_text", "J14": "objects.canonical_objects"}
    for code, operator in calls.items():
        sources = [inspect.getsource(f) for covers, f, _ in CATALOG.values() if code in covers.split()]
        assert sources and all(operator in source for source in sources), code


def test_pages(spark):
    page = '<html><title>Liste &amp; suite</title><div class="t x"><div><a href="/a">A</a></div> b<br></div><div class="t">c</div> 12 résultats <ul data-x="[{&quot;a&quot;:1}]"></ul></html>'
    assert one(spark, html.title, page) == "Liste & suite"
    assert one(spark, html.advertised_count, page) == 12
    assert [tuple(x) for x in one(spark, html.links, page)] == [("/a", "A")]
    assert one(spark, lambda c: html.attribute_json(c, "data-x", "array<struct<a:int>>"), page)[0].a == 1
    assert one(spark, lambda c: html.first_json(c, "a int"), ")]}' {\"a\": 3}").a == 3
    got = html.blocks(spark.createDataFrame([("p", page), ("q", None)], "id string, h string"), "id", "h", "t").collect()
    assert [(r.block_no, r.text, list(r.urls)) for r in got] == [(0, "A b", ["/a"]), (1, "c", [])]
    assert one(spark, lambda c: readers.page_stats(readers.pages(c)).pages, "a\f\fb") == 3
    assert one(spark, readers.file_kind, bytearray(b"%PDF-1.7"), "binary") == "pdf"


def test_questions():
    names = {"Vérandes": "Vérandes", "Haut-Vérandes": "Haut-Vérandes"}
    spec = question.understand("Quelles interpellations à Haut-Vérandes ont reçu une réponse en 2025 ?", names)
    assert (spec.route, spec.city, spec.response_year, spec.year) == ("answered", "Haut-Vérandes", "2025", None)
    assert question.understand("Combien de postulats entre 2025 et 2023 par des femmes ?", names).year_range == ("2023", "2025")
    assert question.understand("Liste des motions restées sans réponse en 2024", names).route == "unanswered"
    assert question.understand("Que dit l’article 12bis du règlement du Conseil ?", names).article == "12bis"
    assert question.understand("Budget 2024", names, {"city": "all", "year": "2023"}).year == "2023"
    towns = {"Vérandes": {"enabled": True, "types": ["motion"], "names": []}, "Aubrény": {"enabled": False, "types": [], "names": ["Aub"]}}
    assert question.conflict("Les motions d’Aub ?", {}, towns) == "town_unavailable"
    assert question.conflict("Les motions ?", {"city": "Aubrény"}, towns) == "city_unavailable"
    assert question.conflict("Les postulats de Vérandes", {}, towns) == "type_unavailable"
    assert question.conflict("Les motions de 2022", {"year": 2023, "city": "Vérandes"}, towns) == "year"
    assert question.conflict("Les motions", {"doc_type": "postulats"}, towns) == "type"
    assert question.conflict("Les motions de Vérandes en 2022", {"city": "all", "year": "2022"}, towns) is None
    assert question.follows_up("Et en 2024 ?") and question.follows_up("Combien de motions ont été déposées par des femmes ?") and not question.follows_up("Quels objets ont été déposés par des femmes ?")
    assert question.is_complex("Compare 2021") and question.is_complex("Le lac et la route") and not question.is_complex("Que dit « le lac et la route » ?")
    assert question.find_range("de 2020-2019 ou entre 2023 et 2021") == ("2021", "2023")


def test_providers(spark):
    df = spark.createDataFrame([("a", "un deux"), ("b", None)], "id string, t string")
    got = {r.id: r.embedding for r in providers.embedded(df, "t", providers.HashEmbedder(8)).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-9 and got["b"] == [0.0] * 8


def test_stream_of_probes(spark, tmp_path):
    cols = "pdf_url string, title string, content_length long, last_modified string, etag string, first_seen timestamp, last_checked timestamp"
    folder = str(tmp_path / "in")
    table, log = store.Table(spark, str(tmp_path / "t")), store.Table(spark, str(tmp_path / "l"))
    for title in ("t", "T"):
        spark.createDataFrame([("u", title, 1, "m", "e", None, None)], cols).write.mode("append").parquet(folder)
        changes.stream_changes(spark.readStream.schema(cols).parquet(folder), table, log, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["change_type"] for r in log.read().collect()) == ["new", "renamed"]
    assert table.read().first().title == "T"


def test_batch_delivered_twice(spark, tmp_path):
    cols = "pdf_url string, title string, content_length long, last_modified string, etag string, first_seen timestamp, last_checked timestamp"
    folder = str(tmp_path / "in")
    table, log = store.Table(spark, str(tmp_path / "t")), store.Table(spark, str(tmp_path / "l"))
    spark.createDataFrame([("u", "t", 1, "m", "e", None, None)], cols).write.parquet(folder)
    for name in ("a", "b"):  # a lost checkpoint: the first batch comes again
        changes.stream_changes(spark.readStream.schema(cols).parquet(folder), table, log, str(tmp_path / name)).awaitTermination()
    assert [r["change_type"] for r in log.read().collect()] == ["new"] and table.read().count() == 1


def test_leading_scores_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(6)
    words = "lac route école parc bus vélo piscine budget crédit chauffage arbres quai".split()
    keys = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)]
    rows = [(f"l{i}", f"r{j}", a, b, rng.choice([0.0, 0.08])) for i, a in enumerate(keys[:12]) for j, b in enumerate([*keys, "", None])]
    pairs = spark.createDataFrame(rows, "l string, r string, lk string, rk string, bonus double")
    plain = linkage.similarity(pairs, "lk", "rk").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.col("bonus")))
    best = lambda df: {r.l: (r.r, round(r.score, 9), round(r.margin, 9)) for r in dedup.best_and_margin(df.select("l", "r", "score"), "l", "r", "score").collect()}
    assert best(linkage.leading_scores(pairs)) == best(plain)
