"""Goldens and invariants of the search engine, on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions.query import clamped, effective, ngrams, parse, parse_valid, plural_base, plural_class, valid_weights
from quarry.functions.text import clean, tokens
from quarry.operators import correct, evaluate, extract, index, search, validate
from quarry.plans import jobs
from quarry.sources import records as R

GOLDENS = [
    ("Spider-Man: No Way Home", "spiderman spider man way home"), ("stories dies series", "story die sery"), ("running king being", "runn king being"),
    ("wanted used red", "want used red"), ("dogs gas pass", "dog gas pas"), ("3D x2 TV DC 1994 42", "tv dc 1994"), ("Amélie's café", "amly caf"),
    ("The year one", "year one"), ("beds ties sing", "bed tie sing"), ("see https://x.y/z now", "see now"), ("well-known", "well known"), ("a\x1cred b\x85cat", "red bcat"), ("", ""), (None, ""),
]


def test_analyser(spark):
    df = spark.createDataFrame([(t, w) for t, w in GOLDENS], "t string, want string")
    for r in df.select("t", "want", F.array_join(tokens(clean(F.col("t"))), " ").alias("got")).collect():
        if r["t"] and "\x85" in r["t"]:
            continue  # covered by the next test
        assert r["got"] == r["want"], r["t"]


def test_unicode_blanks(spark):
    got = spark.createDataFrame([("one\x85two three\x1cfour",)], "t string").select(clean(F.col("t"))).first()[0]
    assert got == "one two three four"


@pytest.mark.parametrize(("query", "weights", "terms"), [
    ("title:0 genres:1 stars:0 summaries:0 matrix", (0, 0, 1, 0), "matrix"), ("summary:0.4 drama", (1, 0.4, 1, 1), "drama"),
    ("stars:-1 title:2 prison escape", (2, 1, 1, 0), "prison escape"), ("director:1.0 tom hanks", (1, 1, 1, 1), "director:1.0 tom hanks"),
    ('stars:1 "lord of the rings"', (1, 1, 1, 1), "lord of the rings"), ("Title:2 x", (1, 1, 1, 1), "title:2 x"), ("title:1. title:+1", (1, 1, 1, 1), "title:1. title:+1"),
    ("title:.5 title:3 title:.25", (0.25, 1, 1, 1), ""), ("don't", (1, 1, 1, 1), "don t"), ("", (1, 1, 1, 1), ""), (None, (1, 1, 1, 1), ""),
])
def test_parse(query, weights, terms):
    got, words = parse(query)
    assert tuple(got[f] for f in ("title", "summaries", "genres", "stars")) == weights
    assert " ".join(words) == terms


def test_weights():
    assert valid_weights({"title": -1}) and not valid_weights({"x": 1}) and not valid_weights({"title": "1"})
    assert clamped({"title": -1.0, "stars": 2.0}) == {"title": 0.0, "stars": 2.0}
    assert effective({"title": 0.0, "stars": 2.0}) == {"title": 0.01, "stars": 2.0}
    assert parse_valid("title:-3 a")[0]["title"] == 0.0
    assert ngrams("a b c b c".split()) == [["a", "b", "c"], ["b", "c", "b"], ["c", "b", "c"], ["a", "b"], ["b", "c"], ["c", "b"]]


ROWS = [
    ("d1", 0, "star wars", ["the star ship of war"], ["drama"], ["tom hanks"]),
    ("d2", 1, "star trek", ["a trek to a star", "star wars star"], ["drama", "crime"], []),
    ("d3", 2, "quiet town", ["summary not found."], ["crime"], None),
    ("d1", 3, "star wars again", None, None, None),
    ("", 4, "no id", None, None, None),
    ("d5", 5, "of the", None, None, None),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    records = spark.createDataFrame(ROWS, "id string, seq bigint, title string, summaries array<string>, genres array<string>, stars array<string>")
    analysed = index.field_tokens(records).cache()
    path = str(tmp_path_factory.mktemp("index"))
    R.write_index(index.build(records), path)
    return analysed, R.read_index(spark, path)


def test_index(built):
    analysed, tables = built
    rows = {(r["term"], r["doc_id"], r["field"]): (r["tf"], r["positions"]) for r in tables["postings"].collect()}
    assert rows["star", "d2", "summaries"] == (3, [1, 2, 4])
    assert rows["war", "d1", "title"] == (1, [1])  # the last record with d1's id counts
    assert ("drama", "d1", "genres") not in rows and not any(k[2] == "summaries" and k[1] == "d3" for k in rows)
    assert {r["doc_id"]: r["doc_seq"] for r in analysed.where("doc_len > 0").collect()} == {"d1": 0, "d2": 1, "d3": 2}
    df = {r["term"]: r["df"] for r in tables["terms"].collect()}
    assert df["star"] == 3
    assert index.integrity(analysed, tables["postings"], tables["terms"]).first()[:] == (0, 0, 0)
    meta = tables["meta"].first()
    assert (meta["total_documents"], meta["total_tokens"]) == (3, sum(v[0] for v in rows.values()))


def model_search(tables, weights, query, k):
    """BM25 with boosts in plain Python, from the specification."""
    posts = [r.asDict() for r in tables["postings"].collect()]
    df = {r["term"]: r["df"] for r in tables["terms"].collect()}
    lens = {}
    for p in posts:
        lens[p["doc_id"]] = lens.get(p["doc_id"], 0) + p["tf"]
    n, avg = len(lens), sum(lens.values()) / len(lens)
    score, parts = {}, {}
    for t in query:
        for p in sorted((p for p in posts if p["term"] == t), key=lambda p: (p["doc_seq"], p["field_seq"])):
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
            w = weights.get(p["field"], 1.0)
            s = (w if w > 0 else 0.01) * idf * p["tf"] * 2.2 / (p["tf"] + 1.2 * (0.25 + 0.75 * lens[p["doc_id"]] / avg))
            score[p["doc_id"]] = score.get(p["doc_id"], 0) + s
            parts.setdefault(p["doc_id"], set()).add(t)
    pos = lambda d, t: sorted(x for p in posts if p["doc_id"] == d and p["term"] == t for x in p["positions"])
    final = dict(score)
    for words in ngrams(query):
        if not all(w in df for w in words):
            continue
        docs = set.intersection(*({p["doc_id"] for p in posts if p["term"] == w} for w in words))
        gaps = [q - p - 1 for d in docs for a, b in zip(words, words[1:]) for p in pos(d, a) for q in pos(d, b) if q > p]
        if len(docs) < 2 or not gaps or sum(gaps) / len(gaps) > 6:
            continue
        for d in score:
            if set(words) <= parts[d]:
                at = pos(d, words[0])
                for w in words[1:]:
                    at = [q for p in at for q in pos(d, w) if 0 < q - p <= 3]
                if at:
                    final[d] += score[d] * 0.5
    return sorted(final.items(), key=lambda x: -x[1])[:k]


@pytest.mark.parametrize("query", ["star war", "title:3 star star trek", "crime drama", "stars:0 star war again", "nothing"])
def test_search_against_model(spark, built, query):
    _, tables = built
    weights, terms = parse(query)
    got = [(r["doc_id"], r["score"]) for r in search.search(spark, tables, weights, terms, 3).orderBy("rank").collect()]
    want = model_search(tables, weights, terms, 3)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_empty_query(spark, built):
    assert search.search(spark, built[1], *parse("title:2"), 5).count() == 0


def test_explain(built):
    weights, terms = parse("star star war")
    r = search.explain(built[1], weights, terms, "d2").first()
    assert r["total_score"] == pytest.approx(sum(r["field_contributions"].values()))
    assert r["token_contributions"]["star"]["field"] == "summaries" and r["length"] == 9


def test_idf_may_be_negative(spark):
    got = spark.sql("SELECT 1000D AS n, d FROM VALUES (3D), (1000D), (1001D), (4000D) t(d)").select(search.idf(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in got] == pytest.approx([5.655992, 0.0005, -0.000499, -1.38542], abs=1e-6)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10)], "term string, df bigint")
    assert index.df_summary(df).first()[:] == (1, 10, 4.0, 3)


def test_correction(spark):
    terms = spark.createDataFrame([("star", 9), ("story", 5), ("war", 7), ("spiderman", 4), ("matrix", 1), ("matrices", 6), ("bus", 3), ("box", 8), ("babies", 2)], "term string, df bigint")
    asked = spark.createDataFrame([(t,) for t in ("stars", "stor", "spider-man", "baby", "matrx", "the", "xy", "1994", "stat", "boxs")], "term string")
    got = {r["given"]: (r["corrected"], r["rule"]) for r in correct.corrections(asked, terms, 100).collect()}
    assert got == {
        "stars": ("stars", "plural"), "stor": ("star", "nearest"), "spider-man": ("spiderman", "joined"), "baby": ("babies", "variant"), "matrx": ("matrx", "unknown"),
        "the": ("the", "plain"), "xy": ("xy", "plain"), "1994": ("1994", "plain"), "stat": ("star", "nearest"), "boxs": ("boxs", "plural"),
    }


def test_plurals(spark):
    words = ["stories", "boxes", "dogs", "glass", "is", "ies", "buses", "cat"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", plural_base(F.col("w")), plural_class(F.col("w"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"stories": ("story", "IES"), "boxes": ("box", "ES"), "dogs": ("dog", "S"), "glass": ("", "S"), "is": ("", "S"), "ies": ("ie", "S"), "buses": ("bus", "ES"), "cat": ("", "NONE")}


def test_measures(spark):
    queries = spark.createDataFrame([(0,), (1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "x", 1)], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(0, "b"), (0, "b"), (0, "c"), (1, "y")], "query_id int, doc_id string")
    m = evaluate.per_query(queries, hits, qrels)
    assert evaluate.at_five(m).first()[:] == pytest.approx((0.2 / 3, (1 / 3) / 3, 0.5 / 3))
    assert {r["query_id"]: (r["precision"], r["recall"], r["passed"]) for r in evaluate.passes(m, 0.5).collect()} == {0: (0.5, 0.5, True), 1: (0.0, 0.0, False), 2: (0.0, 0.0, False)}


GOOD = dict(
    id="tt0111161", title="A", first_page_summary="x", release_year="1994", mpaa="R", budget="$1", gross_worldwide="$2", rating="9.3", directors=["d"], writers=["w"], stars=["s"],
    related_links=["https://www.imdb.com/title/tt0068646/"], genres=["g"], languages=["English"], countries_of_origin=["US"], summaries=["s1"], synopsis=[], reviews=[["good", "9"]],
)


def test_validation(spark, tmp_path):
    bad = dict(
        GOOD, id="x1", title=" ", release_year="94", rating=9.3, budget="none", languages=["Languages not found."], directors="d", writers=["a", "a", ""], stars=[1, "b"],
        related_links=["http://x/", "https://www.imdb.com/name/nm1/", GOOD["related_links"][0], GOOD["related_links"][0]], reviews=[["", "11"], ["t"], "no", ["t", 5], ["t", "good"]],
    )
    absent = {k: v for k, v in GOOD.items() if k != "related_links"} | {"id": "tt0111163"}
    null = dict(GOOD, id="tt0111162", related_links=None)
    path = tmp_path / "r.json"
    path.write_text(json.dumps([GOOD, bad, absent, null, 5, GOOD]))
    rows = [(r["seq"], r["severity"], r["field"]) for r in validate.findings(R.json_items(spark, str(path))).collect()]
    assert [r for r in rows if r[0] == 0] == [(0, "error", "id")]  # its id is there twice
    assert (2, "error", "related_links") not in rows and (3, "error", "related_links") in rows and (4, "error", "") in rows
    for want in [("error", "id"), ("warning", "title"), ("warning", "release_year"), ("error", "rating"), ("warning", "budget"), ("placeholder", "languages"), ("error", "directors"), ("warning", "writers"), ("error", "stars"), ("warning", "related_links"), ("warning", "reviews"), ("error", "reviews")]:
        assert (1, *want) in rows, want
    assert sum(r == (1, "warning", "related_links") for r in rows) == 3
    assert validate.validate(spark, str(path), 1) == 1


@pytest.mark.parametrize(("data", "args", "code"), [([dict(GOOD, id=f"tt{i:07d}") for i in range(6)], {}, 0), ([GOOD], {}, 1), ({"a": 1}, {}, 1), ([dict(GOOD, budget="none")], {"min_count": 1, "fail_on_warning": True}, 2)])
def test_exit_codes(spark, tmp_path, data, args, code):
    path = tmp_path / "v.json"
    path.write_text(json.dumps(data))
    said = []
    assert validate.validate(spark, str(path), **args, say=said.append) == code
    assert ("PASSED" if code == 0 else "FAILED") in said[0] and f"Records: {len(data) if isinstance(data, list) else 0}" in said[0]


def test_index_files(spark, built, tmp_path):
    _, tables = built
    assert R.read_vocabulary(spark, str(tmp_path / "none")).count() == 0
    R.write_index_json(tables, str(tmp_path / "j"))
    columns = ["term", "doc_id", "field", "tf", "positions"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(columns).collect())
    assert rows(R.read_index_json(spark, str(tmp_path / "j"))) == rows(tables["postings"])
    again = R.read_index_json_metadata(spark, str(tmp_path / "j")).first()
    assert again["total_documents"] == 3 and again["field_distribution"] == tables["meta"].first()["field_distribution"]
    parts = R.index_entries(tables, chunk=1)
    assert parts.count() == tables["postings"].count() and parts.where("size(postings) > 1").isEmpty()
    # the form of one object over many lines
    entries = {"star": {"df": 1, "postings": [{"doc_id": "a", "tf": 1, "positions": [4], "field": "title"}]}}
    (tmp_path / "one.json").write_text(json.dumps({"metadata": {"total_documents": 1}, "index": entries}, indent=2))
    assert rows(R.read_index_json(spark, str(tmp_path / "one.json"))) == [("star", "a", "title", "1", "[4]")]
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(ValueError):
        R.read_index_json(spark, str(tmp_path / "bad.json"))
    with pytest.raises(Exception):  # noqa: B017
        R.read_index_json(spark, str(tmp_path / "absent.json")).count()


def test_empty_index(spark, built, tmp_path):
    analysed, _ = built
    R.write_index(index.postings(index.tokens_long(analysed.limit(0))), str(tmp_path / "e"))
    tables = R.read_index(spark, str(tmp_path / "e"))
    assert tables["meta"].select("total_documents", "avg_dl", "total_tokens").first()[:] == (0, 1.0, 0)
    assert search.search(spark, tables, *parse("star war"), 2).count() == 0
    R.write_index_json(tables, str(tmp_path / "ej"))
    assert R.read_index_json(spark, str(tmp_path / "ej")).count() == 0


def test_tokens_file(spark, built, tmp_path):
    analysed, _ = built
    R.write_tokens_json(analysed, str(tmp_path / "t"))
    got = {(r["doc_id"], r["field"]): r["tokens"] for r in R.read_tokens_json(spark, str(tmp_path / "t")).collect()}
    assert got["d2", "summaries"][:2] == ["trek", "star"] and {d for d, _ in got} == {"d1", "d2", "d3"}
    assert index.processed_violations(analysed).isEmpty()
    broken = spark.createDataFrame([("", 0, 3, [("title", 0, ["a", " "]), ("title", 0, []), ("x", 0, [])])], "doc_id string, doc_seq bigint, doc_len bigint, fields array<struct<field:string,field_seq:int,tokens:array<string>>>")
    assert {r["rule"] for r in index.processed_violations(broken).collect()} == {"no id", "unknown field", "repeated field", "blank token", "length"}


def test_phrases_against_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = []
    for i in range(40):
        places = {w: sorted({r.randrange(40) for _ in range(r.randint(1, 15))}) for w in "abc"}
        gaps = [q - p - 1 for x, y in ("ab", "bc", "ca") for p in places[x] for q in places[y] if q > p]
        fits = {}
        for most in (1, 3):
            at = places["a"]
            for w in "bca":
                at = [q for q in places[w] if any(0 < q - p <= most for p in at)]
            fits[most] = bool(at)
        rows.append((i, places, sum(gaps), len(gaps), fits[3], fits[1]))
    df = spark.createDataFrame(rows, "i int, places map<string,array<int>>, total bigint, pairs bigint, near boolean, next boolean")
    words = F.array(*map(F.lit, "abca"))
    got = df.select("*", search._gaps(F.col("places"), words).alias("g"), search.flexible(F.col("places"), words).alias("f"), search.flexible(F.col("places"), words, exact=True).alias("e"))
    for x in got.collect():
        assert (x["g"]["total"], x["g"]["pairs"], x["f"], x["e"]) == (x["total"], x["pairs"], x["near"], x["next"])


def test_batch_equals_single(spark, built):
    _, tables = built
    asked = ["star war", "title:3 star star trek", "crime drama"]
    queries = spark.createDataFrame([(i, *parse(q)) for i, q in enumerate(asked)], "query_id int, weights map<string,double>, terms array<string>")
    got = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in search.batch_search(tables, queries, 2).collect()}
    for i, q in enumerate(asked):
        weights, terms = parse(q)
        for x in search.top(search.scored(search.contributions(tables, weights, terms)).withColumn("score", F.col("base")), 2).collect():
            assert got[i, x["rank"]] == (x["doc_id"], pytest.approx(x["score"]))


PAGE = """<html><body><h1> The Film </h1><span data-testid="plot-xl">A plot.</span>
<li data-testid="title-pc-principal-credit"><span class="ipc-metadata-list-item__label">Director</span><a class="ipc-metadata-list-item__list-content-item x">Ann B</a></li>
<li data-testid="title-pc-principal-credit"><a class="ipc-metadata-list-item__label">Stars</a><a class="ipc-metadata-list-item__list-content-item">Z</a><a class="ipc-metadata-list-item__list-content-item">C D</a></li>
<div data-testid="hero-rating-bar__aggregate-rating__score"><span>8.7</span><span>/10</span></div>
<li class="ipc-metadata-list__item"><span class="ipc-metadata-list-item__label">Certificate</span><span class="ipc-metadata-list-item__list-content-item">R</span></li>
<a href="/x/releaseinfo?y">1994</a><div class="ipc-chip-list__scroller"><span class="ipc-chip__text">Drama</span></div>
<li data-testid="title-boxoffice-budget"><span class="ipc-metadata-list-item__list-content-item">$5</span></li>
<a href="/search?country_of_origin=US">USA</a>
<section data-testid="MoreLikeThis"><a class="ipc-lockup-overlay ipc-focusable" href="/title/tt0000002/?r">x</a></section></body></html>"""
LD = '<script type="application/ld+json">[{"a":1},{"aggregateRating":{"ratingValue":7.5},"contentRating":"PG"}]</script>'


def test_extraction(spark):
    sub = '<div data-testid="sub-section-summaries"><li><div class="ipc-html-content-inner-div">S &amp; T</div></li></div><div data-testid="sub-section-synopsis">Long.</div>'
    rev = '<div class="lister-list"><div class="lister-item a"><div class="text show-more__control">Fine</div><span class="rating-other-user-rating"><span>8</span></span></div><div class="lister-item"></div></div>'
    pages = spark.createDataFrame([("https://www.imdb.com/title/tt0000001/", PAGE, sub, rev), ("https://h/title/tt3", LD, None, None), ("https://h/x", None, None, None)], "url string, html string, summary_html string, reviews_html string")
    got = {r["id"]: r.asDict() for r in extract.records(pages).collect()}
    one = got["tt0000001"]
    assert (one["title"], one["first_page_summary"], one["directors"], one["writers"], one["stars"]) == ("The Film", "A plot.", ["Ann B"], [], ["C D", "Z"])
    assert (one["rating"], one["mpaa"], one["release_year"], one["genres"], one["budget"], one["gross_worldwide"]) == ("8.7", "R", "1994", ["Drama"], "$5", "Gross worldwide tag not found.")
    assert (one["countries_of_origin"], one["languages"], one["summaries"], one["synopsis"], one["reviews"]) == (["USA"], ["Languages not found."], ["S & T"], ["Long."], [["Fine", "8"], ["", "N/A"]])
    assert (got["tt3"]["rating"], got["tt3"]["mpaa"], got["tt3"]["title"]) == ("7.5", "PG", None)
    assert got[None]["rating"] == "Rating not found."


def test_crawl(spark, tmp_path):
    def page(i):
        links = "".join(f'<a class="ipc-lockup-overlay ipc-focusable" href="/title/t{j}/">x</a>' for j in ((i + 1) % 6, (i + 2) % 6))
        return f'<h1>{i}</h1><section data-testid="MoreLikeThis">{links}</section>'

    site = spark.createDataFrame([(f"t{i}", page(i)) for i in range(5)], "id string, html string")  # t5 can't be had
    keep = lambda df, turn: df.write.parquet(str(tmp_path / str(turn))) or spark.read.schema(df.schema).parquet(str(tmp_path / str(turn)))
    chart = spark.createDataFrame([('<li class="ipc-metadata-list-summary-item"><a href="/title/t0/?r">a</a></li>' * 2,)], "html string")
    frontier = extract.seeds(chart)
    fetch = lambda f: f.join(site, "id").select("url", "html")
    got, left = extract.crawl(spark, fetch, frontier, 10, keep)
    assert sorted(r["id"] for r in got.collect()) == ["t0", "t1", "t2", "t3", "t4"] and left.isEmpty()
    # stopped and taken up again
    target = str(tmp_path / "crawl")
    assert jobs.crawl(spark, target, 2, fetch, chart) == 2
    assert {r["id"] for r in R.read_json(spark, f"{target}/remaining", jobs.FRONTIER).collect()} == {"t2", "t3"}
    assert jobs.crawl(spark, target, 2, fetch) == 4 and jobs.crawl(spark, target, 50, fetch) == 5
    assert jobs.load(spark, target).count() == 5 and R.read_json(spark, f"{target}/remaining", jobs.FRONTIER).isEmpty()
    assert jobs.crawl_or_load(spark, target, 5) == "" and "expected" in jobs.crawl_or_load(spark, target, 6) and "not found" in jobs.crawl_or_load(spark, str(tmp_path / "x.json"), 1)
