import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import canonical, distinctive, langid, leakage, neardup, packing, queries, siteblocks, sitetree, stuffing
from quern.llm.pagetext import blocks
from quern.llm.residue import residue_words
from quern.storage import bucketed

PAGES = "page_id long, url string, content string, html string, loaded_at timestamp, lines int"
SENTENCES = [f"The keeper of number {n} wrote that the {a} {b} was moved to the old hall before the rain came again." for n, (a, b) in enumerate(combinations("lamp mill ferry clock pump garden shelf loom kiln depot".split(), 2))]


def _page(k, host="h", body=None):
    body = body if body is not None else "\n".join(f"<p>{s}</p>" for s in SENTENCES[3 * k : 3 * k + 3])
    return (k, f"http://{host}.example/{k}", f"<html><title>Page {k}</title>\n<body><div class=x1><p>Home | News | Contact</p></div>\n<div class=x2>\n<h1>Page {k}</h1>\n{body}\n</div>\n<div class=x3><p>Follow us and never miss an update</p></div></body></html>", None, None, 1)


def test_pages_are_judged(spark):
    rows = [_page(k) for k in range(8)] + [
        _page(20, body="<p>Error establishing a database connection</p>"),
        _page(21, body="<p>" + "best red lamp, cheap red lamp, " * 30 + "</p>"),
        (30, None, None, None, None, 1), (31, "u", "", "", None, 1), (None, "u", "x", None, None, 1), (0, "http://h.example/0", _page(0)[2], None, None, 1),
        (40, None, "No markup here, a first line\n\n" + SENTENCES[40], None, None, 1),
        (41, "http://[bad", "<p>" + "a" * 300_000, None, None, 1),
    ]
    judged = sitetree.judge_pages(spark.createDataFrame(rows, PAGES), texts=True, keys=True)
    found = {r.page_id: r for r in judged.collect()}
    assert len(found) == 14
    assert found[20].residual and not found[20].stuffed and found[21].stuffed and not found[21].residual
    assert found[3].lines == [4, 5, 6, 7] and not found[3].residual and not found[3].stuffed
    assert found[30].lines == [] and found[30].visible is None and found[31].visible is None
    assert found[40].lines == [3]
    assert sitetree.judge_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_tables_and_lists_without_markup_are_main():
    rows, items = ["lamp\t18.1\tMuma", "mill\t21\tKizra", "kiln\t86\tBroza"], ["- 53 lamps", "- 17 mills", "- 5 kilns"]

    def lines(text):
        return siteblocks.verdict(siteblocks.facts("\n".join(text), "h.example")).lines

    assert lines(["Title | Site", "", "Heading", *SENTENCES[:2], *rows, SENTENCES[2], *items, *SENTENCES[3:5]]) == list(range(3, 15))
    assert lines(["Title | Site", "Home > News > Heading", "Price list 47", *rows, *SENTENCES[:2]]) == list(range(3, 9))
    assert lines(["Title | Site", "", "Price list 47", *items, *SENTENCES[:2]]) == list(range(3, 9))
    assert lines(["Title | Site", "", *SENTENCES[:2], *rows, "", "Shop  Prices"]) == list(range(3, 8))
    assert lines(["Title | Site", "", "Home  News", "Shop  Prices", "", "Heading", *SENTENCES[:2], "", "* Another lamp", "* Another mill"]) == [6, 7, 8]
    assert not {5, 6} & set(lines(["Title | Site", "", *SENTENCES[:2], "Read also", "* Another lamp", "* Another mill", "", SENTENCES[2]]))


def test_residue_is_not_about_residue():
    assert residue_words("404 Not Found") and residue_words("Dear {{ name }}, welcome to {{ city }}.")
    assert not residue_words("The team found that an internal server error appeared only while the nightly copy was running.")


def test_blocks_and_visible_text():
    page = blocks("<p>a<b>b</b>\nc</p><script>x</script><ul><li>d")
    assert [(b.text, b.lines) for b in page] == [("ab c", [1, 2]), ("d", [2])]
    shown = []
    siteblocks.facts("<p>A&eacute;, b</p><style>z</style>", "", None, shown)
    assert blocks(None) == [] and shown == ["aéb"]


def test_urls_and_ledger(spark):
    urls = spark.createDataFrame([(1, " HTTP://A.b:80/X?b=2&a=1#f "), (2, "http://a.b/X?a=1&b=2"), (3, "http://a.b/x?a=1&b=2"), (4, None), (5, " ")], "id long, url string")
    rows = canonical.with_canonical_url(urls, "url", "key").select("id", "key")
    assert [r.key for r in rows.orderBy("id").collect()] == ["http://a.b/X?a=1&b=2"] * 2 + ["http://a.b/x?a=1&b=2", None, None]
    counts, ledger = canonical.duplicates_in(rows, [F.col("id") > 1, F.col("id") <= 1])
    assert {(r.copies, r.first_id) for r in counts.collect()} == {(2, 1), (1, 3)}
    assert [(r.first_id, r.copy_id) for r in canonical.copies_of(rows, counts).collect()] == [(1, 2)]
    ledger.add(rows.limit(0))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    sets = {}
    for k in range(120):
        base = set(sets[rng.choice(list(sets))]) if sets and rng.random() < 0.6 else {rng.randrange(10**6) for _ in range(40)}
        for _ in range(rng.randrange(8)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(10**6))
        sets[k] = base
    sets[500] = set()
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, elements array<int>")
    got = {(r.id_a, r.id_b) for r in neardup.expand(*neardup.near_duplicates(frame, 0.7, bands=64, rows=4)).collect()}
    crowded = {(r.id_a, r.id_b) for r in neardup.expand(*neardup.near_duplicates(frame, 0.7, bands=64, rows=4, most=2)).collect()}
    assert crowded == got == {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def test_sets_in_buckets_are_not_moved_by_joins(spark, monkeypatch):
    """Neither the representatives nor the verification moves the sets that p4_found writes."""
    plans = []
    monkeypatch.setattr(queries, "bucketed", lambda *x: plans.append(bucketed(*x)) or plans[-1])
    monkeypatch.setattr(queries, "_table", lambda s, _, name: s.createDataFrame([_page(k) for k in range(8)], PAGES) if name == "pages" else s.createDataFrame([], "doc_id long, built_at timestamp, dup_urls array<string>"))
    assert queries.p4_found(spark, "").count() == 0
    sets = plans[0]
    assert {r.id for r in sets.collect()} == set(range(8)) and not [t for t in spark.catalog.listTables() if t.name.startswith("quern_")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reps, _ = neardup.representatives(sets)
        assert reps.count() == 8
        plan = reps._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(id") == 1  # of the ids kept, not of the sets


def test_short_near_duplicates_are_all_found(spark):
    rng = random.Random(6)
    sets = {k: sorted(rng.sample(range(30), rng.randrange(1, 9))) for k in range(400)}
    frame = spark.createDataFrame(list(sets.items()), "id long, elements array<int>")
    got = {(r.id_a, r.id_b) for r in neardup.expand(*neardup.near_duplicates(frame, 0.6, exact=True)).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(set(sets[a]) & set(sets[b])) >= 6 * len(set(sets[a]) | set(sets[b]))}
    # four entries, three in common: bands of independent values miss 0.014 %
    missed = 0
    for k in range(0, 60_000, 5):
        one, two = (set(neardup.band_keys(np.array(x, np.uint32), 64, 4)) for x in ([k, k + 1, k + 2, k + 3], [k, k + 1, k + 2, k + 4]))
        missed += not one & two
    assert missed < 10


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(k, rng.choice([1, 5, 17, 30, 64, 100, 250, rng.randrange(1, 400)])) for k in range(3000)] + [(9000, None), (None, 4), (9001, 0), (9002, 1000)]
    caps = spark.createDataFrame([(1, 100), (2, 512), (3, None)], "capacity_id int, max_tokens int")
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), caps).collect()
    kept = {k: n for k, n in sizes if k is not None and n}
    for cap, most in ((1, 100), (2, 512)):
        mine = [r for r in rows if r.capacity_id == cap]
        loads, docs = {}, {}
        for r in mine:
            loads[r.container] = loads.get(r.container, 0) + r.tokens
            docs[r.doc_id] = docs.get(r.doc_id, 0) + r.tokens
            assert r.part == 0 or kept[r.doc_id] > most
        assert docs == kept and max(loads.values()) <= most and sum(kept.values()) / (len(loads) * most) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), caps).count() == 0


def test_leaks(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(6)] + [(9, None)]
    docs = [(k, " ".join(f"x{rng.randrange(500)}" for _ in range(60))) for k in range(60)] + [(90, None), (91, "")]
    docs[7] = (7, "Xy " + items[2][1].upper().replace(" ", " , ", 5) + " zz")
    docs[8] = (8, " ".join(items[3][1].split()[:12]) + " end")
    found = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.where("run >= 13").collect()] == [(7, 2)]
    assert leakage.longest_run("a b c d".split(), "x b c d a".split()) == 3 and leakage.longest_subsequence("a x b c".split(), "a b y c".split()) == 3


@pytest.fixture(scope="module")
def spoken():
    return {
        "en": ["The garden of the keeper is behind the old town hall.", "There was no reason why they waited for the ferry.", "Every window in this house looks over the river."],
        "de": ["Der Garten des Wärters liegt hinter dem alten Rathaus.", "Es gab keinen Grund, warum sie auf die Fähre warteten.", "Jedes Fenster in diesem Haus blickt auf den Fluss."],
    }


def test_languages(spark, spoken):
    rows = [(k, spoken[x][k % 3] + "\n" + spoken[x][(k + 1) % 3], label) for k, (x, label) in enumerate([("en", "en"), ("de", "deu"), ("en", "English"), ("de", "de-AA"), ("en", " EN"), ("de", "DE")] * 5)]
    rows += [(100, "\n\n".join(spoken["en"][:2] + spoken["de"][1:]), "en"), (101, spoken["de"][0], None), (102, spoken["en"][2], "de"), (103, None, "en"), (104, "12 34", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r.doc_id, r.line_no, r.lang) for r in langid.mislabelled(langid.assign_languages(frame, [("en", "English"), ("de", "German")])).collect()}
    lines = {x for x in found if x[0] == 100 and x[1]}
    assert lines == {(100, 1, "en"), (100, 2, "en"), (100, 3, "de"), (100, 4, "de")}
    assert {x for x in found if x[0] != 100} == {(101, 0, "de"), (102, 0, "en")}


def test_distinctive_terms(spark):
    rows = [("common", k, 3) for k in range(5)] + [("rare", 0, 3), ("rare", 0, 3), ("none", 1, None), (None, 1, 2)]
    scored = distinctive.score_terms(spark.createDataFrame(rows, "term string, doc_id long, tfw long"), spark.createDataFrame([(k,) for k in range(6)], "doc_id long"))
    for weight in ("tfidf", "dfr"):
        best = {r.doc_id: r.term for r in distinctive.best_term(scored, F.col(weight)).collect()}
        assert best == {0: "rare", 1: "common", 2: "common", 3: "common", 4: "common"}


def test_link_blocks_keep_their_text(spark):
    linked = "<p><a href='/a'>The committee has printed the annual survey of every harbour and its warehouse</a></p>"
    rows = [_page(k) for k in range(4)] + [_page(9, body="\n".join([f"<p>{s}</p>" for s in SENTENCES[30:32]] + [linked]))]
    found = {r.page_id: r for r in sitetree.judge_pages(spark.createDataFrame(rows, PAGES), texts=True).collect()}
    assert 7 in found[9].lines and "annual survey of every harbour" in found[9].text


def test_ledger_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", 5), ("a", 7), ("b", 3), (None, 1), ("c", None), ("a", 5)], "key string, id long")
    first = canonical.Ledger(spark, path, buckets=3)
    first.add(rows)
    again = canonical.Ledger(spark, path)
    assert again.buckets == 3 and again.version == 1
    again.add(spark.createDataFrame([("a", 2), ("d", 9)], "key string, id long"))
    last = canonical.Ledger(spark, path)
    assert {(r.key, r.copies, r.first_id) for r in last.read().collect()} == {("a", 3, 2), ("b", 1, 3), ("d", 1, 9)}
    assert len({f.split("/v")[1][0] for f in last.files.values()}) <= 2
    counts = last.read()
    all_rows = rows.unionByName(spark.createDataFrame([("a", 2), ("d", 9)], "key string, id long"))
    assert {tuple(r) for r in canonical.copies_of(all_rows, counts).collect()} == {("a", 2, 5), ("a", 2, 7)}


def test_buckets_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(canonical, "KEYS", 10)
    ledger = canonical.Ledger(spark, f"file://{tmp_path}/ledger")
    for k in range(3):
        ledger.add(spark.range(40 * k, 40 * k + 40 * (k + 1)).selectExpr("cast(id % 100 as string) key", "id"))
    assert ledger.buckets == 8 or ledger.buckets == 4
    assert canonical.Ledger(spark, ledger.path).read().agg(F.sum("copies"), F.count("*")).first()[:] == (240, 100)


NOTICES = [
    "Oops! That page can't be found.", "You have JavaScript disabled.", "Sorry, you have been blocked", "Page non trouvée", "Se requiere JavaScript", "Hi {name}",
    "Bandwidth limit exceeded", "Connection timed out", "Pagina no encontrada", "Der Zugriff wurde verweigert.", "KeyError: 'title'", "Dear %(name)s, welcome",
]


def test_notices_that_no_list_holds():
    assert [t for t in NOTICES if not residue_words(t)] == []
    long = " ".join(["server error"] * 40)
    assert residue_words(long) == 80  # of any length


def test_answers_of_many_hosts_are_residue(spark):
    """A wording that no detector knows, given for other titles on many hosts, is residue; a shared article isn't."""
    strange = "<p>Whatever you hoped for has wandered off beyond our reach</p>"
    rows = [_page(k, host=f"h{k % 4}") for k in range(12)]
    rows += [(100 + k, f"http://h{k % 4}.example/a/{k}", _page(k, f"h{k % 4}", strange)[2].replace(f"Page {k}", f"The {'lamp mill ferry clock pump loom kiln depot'.split()[k]}"), None, None, 1) for k in range(8)]
    rows += [(200 + k, f"http://h{k % 4}.example/c/{k}", _page(k, f"h{k % 4}", "<p>Every lamp of the harbour was counted before the ferry came</p>")[2].replace(f"Page {k}", "Lamp of the harbour"), None, None, 1) for k in range(8)]
    found = {r.page_id: r.residual for r in sitetree.judge_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k for k, v in found.items() if v} == set(range(100, 108))


def test_filler_of_many_hosts_is_residue(spark):
    rng = random.Random(8)
    vocabulary = [rng.choice("bdfgklmn") + rng.choice("aeiou") + rng.choice("rstvz") + rng.choice("aeiou") + rng.choice("mnrs") for _ in range(20)]
    rows = [_page(k, host=f"h{k % 4}") for k in range(12)]
    rows += [_page(100 + k, f"h{k % 4}", "<p>" + " ".join(rng.choice(vocabulary) for _ in range(50)).capitalize() + ".</p>") for k in range(8)]
    found = {r.page_id: (r.residual, r.stuffed) for r in sitetree.judge_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k for k, v in found.items() if v[0]} == set(range(100, 108)) and not any(v[1] for v in found.values())


def test_stuffed_pages_are_told_without_moving_their_texts(spark):
    usual = [(k, "t", 0, 200, [(700, 100, 0, 0.5, 0.06, "en")], False) for k in range(30)]
    rows = [
        (40, "t", 0, 100, [(700, 100, 0, 0.2, 0.01, "en")], False),  # far under the baseline, few sentence ends
        (41, "t", 0, 100, [(700, 100, 0, 0.38, 0.06, "en")], False),  # under it, but with the usual ends
        (42, "t", 0, 100, [(700, 60, 0, 0.2, 0.01, "en"), (300, 40, 0, 0.6, 0.08, "en")], False),
        (43, "t", 0, 100, [(700, 100, 0, 0.1, 0.01, "xx")], False),  # a language seen once: by the rule of thumb
        (44, "t", 0, 100, [(60, 100, 80, 0.9, 0.0, "")], False),  # a list
        (45, "t", 90, 100, [(700, 100, 0, 0.2, 0.01, "en")], True),
        (46, None, 0, 0, [], False), (47, None, 0, 0, None, False), (None, "t", 0, 100, [(60, 100, 80, 0.9, 0.0, "")], False),
    ]
    judged = spark.createDataFrame(usual + rows, f"page_id long, text string, residue int, other int, chunks {stuffing.CHUNK_TYPE}, residual boolean").repartition(3)
    flagged = stuffing.flag_stuffed(judged.cache())
    found = {r.page_id: (r.stuffed_words, r.stuffed) for r in flagged.collect()}
    assert len(found) == 39 and all(found[k] == (0, False) for k in range(30))
    assert [found[k] for k in range(40, 48)] == [(100, True), (0, False), (60, True), (100, True), (80, True), (100, False), (None, False), (None, False)]
    assert flagged.columns == [*judged.columns, "stuffed_words", "stuffed"]
    assert "hashpartitioning(page_id" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_important_nodes_are_told_by_entropy(spark):
    """Menus and footers of a language that no list of words holds go by what the site's tree says."""
    rng = random.Random(9)
    syllables = "ka to mi ru sa pe no li hu ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    body = lambda: "\n".join("<p>" + " ".join(word() for _ in range(14)).capitalize() + ".</p>" for _ in range(4))
    rows = [(k, f"http://h.example/{k}", f"<title>{word()}</title>\n<div class=a><p>Tori mika hani</p></div>\n<div class=b>\n{body()}\n</div>\n<div class=c><p>Veli nopo saru kami</p></div>", None, None, 1) for k in range(10)]
    places = sitetree.judge_pages(spark.createDataFrame(rows, PAGES)).where("not residual").collect()
    important = {r.value for r in sitetree._evidence(spark.createDataFrame(rows, PAGES).transform(lambda d: sitetree.page_rows(d).mapInArrow(sitetree._parse, sitetree._PARSED))).select(F.explode("evidence").alias("e")).select("e.*").where("idx between 1000000 and 1999999").collect()}
    assert important == {0, 100} and len(places) == 10


def test_leaks_of_common_words_in_blocks(spark, monkeypatch):
    """A run of thirteen words that are in every document is found, also when the items come in several blocks."""
    monkeypatch.setattr(leakage, "BLOCK", 3)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(13)]
    docs = [(k, " ".join([*rng.sample(common, 13), *(f"x{rng.randrange(900)}" for _ in range(30))])) for k in range(50)]
    items = [(k, " ".join(f"y{k}z{j}" for j in range(20)) + " " + " ".join(rng.sample(common, 13)) + " tail") for k in range(8)]
    docs[5] = (5, " ".join(f"q{k}" for k in range(14)) + " ahead " + " ".join(items[6][1].split()[20:33]) + " behind " + docs[5][1])
    found = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.where("run >= 13").collect()} == {(5, 6)}


def test_one_version_of_a_repeated_document_counts(spark, spoken):
    rows = [(k, spoken[x][k % 3] + "\n" + spoken[x][(k + 1) % 3], x) for k, x in enumerate(["en", "de"] * 10)]
    rows += [(100, "\n".join(spoken["de"] * 2), "de"), (100, spoken["en"][0], "de"), (100, "\n".join(spoken["de"] * 2), "de"), (101, "Donaudampf" * 5_000, "en")]
    found = langid.assign_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), [("en", "English"), ("de", "German")]).collect()
    assert [(r.line_no, r.lang) for r in found if r.doc_id == 100] == [(0, "de")] and len([r for r in found if r.doc_id == 101]) == 1
