import hashlib
import json
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.config import EngineConfig
from quern.functions import codec
from quern.functions.html import parse_page
from quern.functions.porter import stem
from quern.functions.urls import normalize_url, resolve
from quern.http import render
from quern.operators import dedup, heavy
from quern.plans.build import build_index, texts_as_pages


@given(st.lists(st.integers(0, 10**9)).map(sorted))
def test_positions_round_trip(positions):
    assert codec.decode_positions(codec.encode_positions(positions)) == positions


@pytest.mark.parametrize("positions, text", [([], ""), ([0], "AA=="), ([0, 5, 12], "AAUH"), ([10, 15, 300], "CgWdAg=="), ([127, 128, 16512], "fwGAgAE=")])
def test_positions_goldens(positions, text):
    assert codec.encode_positions(positions) == text


def test_urls():
    assert normalize_url("HTTP://User@EX.com:80/A;p=1?x=1;y#f") == "http://user@ex.com/A?x=1;y"
    assert normalize_url("http://x.com") != normalize_url("http://x.com/")
    assert normalize_url(None) == "" and normalize_url("http://[::1") == "http://[::1"
    base = "http://b.com/d/e?q=1"
    assert resolve(base, "?z") == "http://b.com/d/e?z" and resolve(base, "tel:+1") == "tel:+1"
    assert resolve(base, "http://[::1") is None and resolve(base, " ") is None and resolve(base, "mailto:x") is None


def test_zones():
    page = parse_page("<title>T</title><body><h1>Head</h1><p>foo<b>bar <strong>x</strong></b> <!-- c --><noscript><a href='/n'>n</a></noscript><a href='/t'>link</a>", "http://h/")
    assert page["title"] == "T" and page["head"] == "Head" and page["bold"].split() == ["bar", "x", "x"]
    assert page["body"].split()[:3] == ["Head", "foo", "bar"] and page["links"] == [("http://h/t", "link")]
    implied = parse_page("<title>T</title><p>x<h2>Head<p>one<p>two", None)
    assert implied["body"].split() == ["x", "Head", "one", "two"] and implied["title"] == "T" and implied["head"] == "Head"
    assert parse_page("", None)["body"] == "" and parse_page("plain", None)["body"] == "plain"


def test_stem():
    for word, expected in dict(caresses="caress", ponies="poni", relational="relat", hopping="hop", falling="fall", sky="sky", happy="happi", hopefulness="hope", dies="die").items():
        assert stem(word) == expected


def test_render_escapes():
    assert "<b>" not in render("<b>", []) and "No results" in render("x", [])


def test_key_totals(spark):
    rows = [("a", i, 1) for i in range(300)] * 2 + [("b", 1, None), ("c", 1, 5), ("c", 1, 5), (None, 1, 1), ("d", None, 1)]
    frame = spark.createDataFrame(rows, "k string, i long, v long")
    totals = heavy.key_totals(frame, "k", "i", "v")
    assert {tuple(r) for r in totals.collect()} == {("a", 300, 300), ("b", 1, None), ("c", 1, 5)}
    assert [r.key for r in heavy.dominant_keys(totals, 0.5).collect()] == ["a"]
    assert heavy.dominant_keys(heavy.key_totals(frame.limit(0), "k", "i", "v"), 0.5).count() == 0


def test_canonical_map_is_the_sequential_scan(spark):
    rng = random.Random(3)
    fps: list[int] = []
    for _ in range(150):
        x = rng.choice(fps) if fps and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    bands = lambda x: [(x >> 16 * k) & 65535 for k in range(4)]
    near = lambda a, b: any(x == y for x, y in zip(bands(a), bands(b))) and bin(a ^ b).count("1") <= 5
    canonical: list[int] = []
    expected = {}
    for i, x in enumerate(fps, 1):
        found = [(bin(x ^ fps[c - 1]).count("1"), c) for c in canonical if near(x, fps[c - 1])]
        if found:
            expected[i] = min(found)[1]
        else:
            canonical.append(i)
            expected[i] = i
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps, 1)]
    got = dedup.canonical_map(spark.createDataFrame(signed, "doc_id long, fp long"))
    assert {r.doc_id: r.canonical_id for r in got.collect()} == expected


def test_canonical_map_lists_no_pairs_of_a_crowd(spark, monkeypatch):
    """A crowd of fingerprints that are all near the first costs about a pair each, and blocks give what the sequential scan gives."""
    rng = random.Random(5)
    crowd = [0, *rng.sample([sum(1 << 4 * i + k for k in rng.sample(range(4), 1)) << 32 for i in range(8) for _ in range(40)], 32)]
    fps = list(dict.fromkeys([0, *(sum(1 << b for b in rng.sample(range(16, 64), 2)) for _ in range(400)), *crowd]))
    pairs, plain = [], dedup.written

    def counted(df, name):
        found = plain(df, name)
        if name == "edges":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(dedup, "written", counted)
    monkeypatch.setattr(dedup, "FIRST_BLOCK", 128, raising=False)
    got = dedup.canonical_map(spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps, 1)], "doc_id long, fp long"))
    assert {r.canonical_id for r in got.collect()} == {1} and got.count() == len(fps)
    assert sum(pairs) < 3 * len(fps)


def test_golden_search(spark):
    docs = spark.createDataFrame([(1, "apple banana apple", "u1"), (2, "banana cherry", None), (3, "cherry date", "u3")], "doc_id long, text string, url string")
    index = build_index(texts_as_pages(docs), EngineConfig(stem=False))
    norms = {r.doc_id: (round(r.norm, 6), round(r.norm2, 6)) for r in index.docinfo.collect()}
    assert norms == {1: (0.645242, 0.674751), 2: (0.249031, 0.477121), 3: (0.508579, 0.477121)}
    got = [(r["rank"], r.doc_id, r.score, r.url) for r in index.search("apple banana").orderBy("rank").collect()]
    assert got == [(1, 1, 1.103538, "u1"), (2, 2, 0.208105, "doc:2")]
    assert index.search("unknown").count() == 0


def test_exact_groups(spark):
    from quern.functions.hashing import exact_fingerprint

    rows = spark.createDataFrame([(1, "  a \t\n b "), (2, "a b"), (3, None)], "doc_id long, text string")
    groups = defaultdict(set)
    for r in dedup.exact_groups(rows.select("doc_id", exact_fingerprint(rows.text).alias("sha"))).collect():
        groups[r.first_id].add(r.doc_id)
        if r.doc_id < 3:
            assert r.sha == hashlib.sha256(b"a b").hexdigest()
    assert groups == {1: {1, 2}, 3: {3}}


def test_posting_lookup_gives_whole_lists(spark, tmp_path):
    from quern import queries

    rows = [(0, "a", 100, 2, "AA=="), (0, "a", 100, None, "AA=="), (0, "a", 7, 1, ""), (1, "a", 8, 3, "AAUH"), (1, "b", 8, 1, ""), (1, "c", 200, 1, ""), (0, None, 100, 1, "")]
    spark.createDataFrame(rows, "block_id int, term string, doc_id long, tfw long, positions_b64 string").write.parquet(f"{tmp_path}/postings.parquet")
    spark.createDataFrame([(0, "a", 2), (0, "a", None), (1, "a", 1), (1, "b", 1)], "block_id int, term string, df long").write.parquet(f"{tmp_path}/lexicon.parquet")
    found = {tuple(r) for r in queries.queries()["posting_lookup"](spark, str(tmp_path)).collect()}
    assert found == {("a", 3, 0, 100, 2, "AA=="), ("a", 3, 0, 7, 1, ""), ("a", 3, 1, 8, 3, "AAUH")}


def test_json_folder_keeps_every_page(spark, tmp_path):
    """Many small files in several folders under adaptive plans: no page is lost, ids are dense in the order of paths."""
    from quern.sources.pages import json_folder

    for k in range(3000):
        folder = tmp_path / f"f{k % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"p{k:04}.{'JSON' if k % 5 == 0 else 'json'}").write_text(json.dumps({"url": f"http://h.example/{k}", "content": f"text {k} " * (1 + k % 50)}))
    (tmp_path / "f0" / "broken.json").write_text("{nothing")
    (tmp_path / "f0" / "empty.json").write_text("{}")
    (tmp_path / "f0" / "html.json").write_text(json.dumps({"content": "", "html": "<p>h"}))
    (tmp_path / "f0" / "other.txt").write_text("{}")
    rows = sorted(json_folder(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(1, 3004)) and [r.path for r in rows] == sorted(r.path for r in rows)
    by_name = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert by_name["broken.json"].source is None and by_name["empty.json"].source is None
    assert by_name["html.json"].source == "<p>h" and by_name["html.json"].url == by_name["html.json"].path
    assert sum(r.source is not None for r in rows) == 3001


def test_index_round_trip(spark, tmp_path):
    """Pages to an index, saved, loaded, searched and looked up; links weigh on the page they lead to."""
    from quern.plans.build import Index, parse_zones

    html = {
        1: "<title>Lamp</title><body><h1>Old lamp</h1><p>the <b>keeper</b> lit it <a href='/2'>ferry timetable</a>",
        2: "<title>Ferry</title><p>boats leave at noon",
        3: "<title>Ferry</title><p>boats  leave at noon",
    }
    pages = spark.createDataFrame([(k, f"f{k}", f"http://h.example/{k}", v) for k, v in html.items()], "doc_id long, path string, url string, source string")
    build_index(parse_zones(pages), EngineConfig(stem=False), n_paths=5).save(str(tmp_path / "i"))
    index = Index.load(spark, str(tmp_path / "i"), EngineConfig(stem=False))
    assert index.stats.first()[:] == (5, 4, 2)
    assert {r.doc_id: list(r.dup_urls) for r in index.docinfo.collect()} == {1: [], 2: ["http://h.example/3"]}
    weights = {(r.term, r.doc_id): (r.df, r.tfw, list(r.positions)) for r in index.lookup("lamp", "keeper", "ferry", "timetable", "none").collect()}
    config = EngineConfig()
    assert weights[("lamp", 1)] == (1, 1 + config.w_title + config.w_head, [1])
    assert weights[("keeper", 1)] == (1, 1 + config.w_bold, [3])
    assert weights[("timetable", 2)] == (2, config.w_anchor, []) and weights[("ferry", 2)][1] == config.w_title + config.w_anchor
    assert {r.doc_id for r in index.search("noon lamp").collect()} == {1, 2} and index.search("timetable ferry").count() == 0  # words of all documents weigh nothing
    assert {tuple(r) for r in index.lookup(spark.createDataFrame([("noon",), ("noon",)], "term string")).select("term", "doc_id").collect()} == {("noon", 2)}


def test_hot_terms_keep_norms(spark):
    from quern.operators import postings

    rows = [("the", k, 1) for k in range(400)] + [(f"t{k}", k, 2) for k in range(300)]
    norms = {r.doc_id: r.norm for r in postings.norms(spark.createDataFrame(rows, "term string, doc_id long, tfw long"), "term", "tfw", 500).collect()}
    import math

    w = math.log10(500 / 400)
    assert math.isclose(norms[399], w) and math.isclose(norms[0], math.hypot(w, (1 + math.log10(2)) * math.log10(500)))


def test_stemmed_search_is_search_of_stems(spark):
    rng = random.Random(12)
    vocabulary = "relational relations hopping hopped falls falling ponies pony happily happy boats boating keeper keepers".split()
    texts = {k: " ".join(rng.choice(vocabulary) for _ in range(12)) for k in range(1, 30)}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, url string")
    stemmed = lambda text: " ".join(stem(w) for w in text.split())
    one = build_index(texts_as_pages(frame([(k, t, f"u{k}") for k, t in texts.items()])), EngineConfig())
    two = build_index(texts_as_pages(frame([(k, stemmed(t), f"u{k}") for k, t in texts.items()])), EngineConfig(stem=False))
    asked = ["hopping ponies", "relation", "happy boats falling"]
    rows = lambda found: sorted(map(tuple, found.collect()))
    got = rows(one.search(asked))
    assert got and got == rows(two.search([stemmed(q) for q in asked]))


def test_no_limits(spark):
    docs = spark.createDataFrame([(k, f"apple banana w{k}" if k % 2 else f"cherry w{k}", f"u{k}") for k in range(40)], "doc_id long, text string, url string")
    index = build_index(texts_as_pages(docs), EngineConfig(stem=False, phrase_docs=None, max_candidates=None, max_hamming=0))
    assert {r.candidates for r in index.search("apple banana").collect()} == {20}


def test_ranked_search_looks_at_all_candidates(spark, tmp_path):
    """More documents than the engine's usual limit of 5,000 have the query's phrase; all are candidates."""
    from quern import queries

    rows = [(100, "apple banana", "u")] + [(100 * k + 1, f"w{k} apple banana", "u") for k in range(5200)] + [(100 * k + 2, "cherry", "u") for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, url string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.search_ranked(spark, str(tmp_path)).collect()
    assert {r.candidates for r in found} == {5201} and [(r["rank"], r.doc_id) for r in found][0] == (1, 100) and len(found) == 10


def _texts(spark):
    rng = random.Random(8)
    words = ["a", "a", "a", "the", "the", *(f"w{k}" for k in range(30))]
    docs = {k: [rng.choice(words) for _ in range(rng.randrange(0, 15))] for k in range(1200)}
    asked = {**{k: docs[k] for k in range(0, 1200, 50)}, 5001: ["the", "a"], 5002: ["none", "a"], 5003: ["a", "a", "a"], 5004: []}
    return docs, asked, *(spark.createDataFrame(list(x.items()), f"{name} long, terms array<string>") for x, name in ((docs, "doc_id"), (asked, "query_id")))


@pytest.mark.parametrize("one_block", [True, False])
@pytest.mark.parametrize("name", ["boolean_and", "boolean_or", "phrase_hits"])
def test_pairs_of_queries_and_documents_are_not_moved(spark, monkeypatch, name, one_block):
    from quern.operators import search

    docs, asked, doc_rows, query_rows = _texts(spark)
    if not one_block:
        from quern.operators import blocks

        monkeypatch.setattr(blocks, "BLOCK_QUERIES", 9)
    follows = lambda q, d: sum(1 for pair in zip(q, q[1:]) for other in zip(d, d[1:]) if pair == other)
    expected = {
        "boolean_and": lambda: {(q, d) for q, ts in asked.items() for d, ws in docs.items() if ts and set(ts) <= set(ws)},
        "boolean_or": lambda: {(q, d) for q, ts in asked.items() for d, ws in docs.items() if set(ts) & set(ws)},
        "phrase_hits": lambda: {(q, d, n) for q, ts in asked.items() for d, ws in docs.items() if (n := follows(ts, ws))},
    }[name]()
    found = getattr(search, name)(query_rows, doc_rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_limited_search_gives_few_rows_beyond_its_limits(spark):
    """Of 1,200 documents only those that the limits can reach leave the workers, and short of limits all candidates are the same."""
    from quern.operators import blocks, search

    docs, _, doc_rows, query_rows = _texts(spark)
    index = build_index(texts_as_pages(doc_rows.select("doc_id", doc_rows.terms.cast("string").alias("text"), doc_rows.terms.cast("string").alias("url"))), EngineConfig(stem=False, max_hamming=0))
    seen, plain = [], blocks.over

    def counted(docs, asked, schema, work):
        found = plain(docs, asked, schema, work)
        if "all_terms" in schema:
            seen.append(found.count())
        return found

    blocks.over = counted
    try:
        rows = search.scored_candidates(query_rows, index.tables(), EngineConfig(stem=False, min_results=3, phrase_docs=20, max_candidates=7)).collect()
    finally:
        blocks.over = plain
    assert rows and max(r.candidates for r in rows) == 7 and sum(seen) < 27 * 150
    every = EngineConfig(stem=False, phrase_docs=None, max_candidates=None)
    one = search.ranked(search.scored_candidates(query_rows, index.tables(), every), index.docinfo, 10)
    two = search.ranked_all(query_rows, index.tables(), every, 10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
