"""The registered search queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import ngrams, parse, plural_base, plural_class, variants
from ..functions.text import FIELDS, clean, flattened, has_placeholder
from ..operators import correct, evaluate, extract, index, search, validate
from ..sources.records import from_documents, write_index
from ..sources.stored import forget, stored_index

Query = Callable[[SparkSession, str], DataFrame]

QUERY = "title:2 summaries:0.5 ther english eren tion"
PHRASE = "gnu general public license version"
BATCH = {0: QUERY, 1: PHRASE, 2: "genres:3 french que les", 3: "stars:2 source 0007 source"}
ASKED = ["theer", "englis", "tions", "the", "pub-lic", "x", "1994", "erents", "licenses", "verson", "qqqqqq", "generals"]
DOC = "12"
PARSED = [
    QUERY, PHRASE, *list(BATCH.values())[2:], "title:0 genres:1 stars:0 summaries:0 matrix", "summary:0.4 drama", "stars:-1 title:2 prison escape", "director:1.0 tom hanks",
    'stars:1 "lord of the rings"', "Title:2 x", "title:1. title:+1", "title:.5 title:3 title:.25", "don't STOP", "", "genres:007 a:b:c x:1 stars:-.5",
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(_documents(spark, sf_dir))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.field_tokens(_records(spark, sf_dir), unique_ids=True)


def _write(spark: SparkSession, sf_dir: str, path: str) -> None:
    write_index(index.build(_records(spark, sf_dir), unique_ids=True), path)


def _index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stored index of the documents, built where this application has none of them."""
    return stored_index(spark, f"{sf_dir}/documents.parquet", lambda s, path: _write(s, sf_dir, path))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index anew and gives its rows: all analysis and all tables are in this query's time."""
    forget(spark, f"{sf_dir}/documents.parquet")
    tables = _index(spark, sf_dir)
    rows = tables["postings"].agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return rows.crossJoin(tables["terms"].agg(F.count("*").alias("terms"))).crossJoin(tables["doc_stats"].agg(F.count("*").alias("documents")))  # one row each


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    kinds = dict(records.dtypes)
    text = {f: flattened(F.col(f), " " if f == "summaries" else ", ") if kinds[f].startswith("array") else F.col(f) for f in FIELDS}
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.when(~has_placeholder(t), clean(t)).alias("cleaned")) for f, t in text.items()))
    return records.select(F.col("id").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*").where("cleaned <> ''")


def tokens_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.occurrences(_index(spark, sf_dir)["postings"]).select("doc_id", "field", "pos", "term")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)["postings"].select("term", "doc_id", "field", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)["terms"].select("term", "df")


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)["doc_stats"].select("doc_id", "doc_len")


def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)["meta"].select("total_documents", "total_tokens", "unique_tokens", F.round("avg_dl", 6).alias("avg_dl"), F.size("field_distribution").alias("n_fields"), F.size("token_length_distribution").alias("n_lengths"))


def field_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.field_distribution(_index(spark, sf_dir)["doc_stats"])


def token_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_lengths(_index(spark, sf_dir)["terms"])


def _ranked(docs: DataFrame, score: str, k: int) -> DataFrame:
    """Ranks on rounded scores, so that two engines' sums agree on ties."""
    rows = docs.withColumn("score", F.round(score, 6))
    best = rows.orderBy(F.desc("score"), "first_qpos", "doc_seq").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first_qpos", "doc_seq")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, terms = parse(QUERY)
    docs = search.scored(search.contributions(_index(spark, sf_dir), weights, terms))
    return _ranked(docs, "base", 20).select("doc_id", "score", "rank")


def bm25_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, terms = parse(QUERY)
    docs = search.scored(search.contributions(_index(spark, sf_dir), weights, terms))
    return docs.select("doc_id", F.explode("detail").alias("term", "x")).select("doc_id", "term", F.round("x", 6).alias("score"))


def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *parse(q)) for i, q in BATCH.items()]
    queries = spark.createDataFrame(rows, "query_id int, weights map<string,double>, terms array<string>")
    return search.batch_search(_index(spark, sf_dir), queries, 10, digits=6).select("query_id", "doc_id", "score", "rank")


def query_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, " ".join(p), len(p)) for i, p in enumerate(ngrams(parse(PHRASE)[1]))], "place int, phrase string, n int")


def parsed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each field in the asked queries."""
    rows = [(i, f, float(w)) for i, q in enumerate(PARSED) for f, w in parse(q)[0].items()]
    return spark.createDataFrame(rows, "query int, field string, weight double")


def parsed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, k, t) for i, q in enumerate(PARSED) for k, t in enumerate(parse(q)[1])]
    return spark.createDataFrame(rows, "query int, place int, term string")


def sequential_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first three words of the phrase one right after another."""
    weights, terms = parse(PHRASE)
    docs = search.scored(search.contributions(_index(spark, sf_dir), weights, terms[:3]))
    words = F.array(*map(F.lit, terms[:3]))
    fits = F.when(F.size(F.array_except(words, F.map_keys("places"))) == 0, search.flexible(F.col("places"), words, exact=True)).otherwise(F.lit(False))
    return docs.select("doc_id", fits.alias("sequential"))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share ids: the last with tokens counts, at the place of the first."""
    records = _records(spark, sf_dir).withColumn("id", (F.col("seq") % 97).cast("string"))
    return index.field_tokens(records).where("doc_len > 0").select("doc_id", "doc_seq", "doc_len")


def phrase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, terms = parse(PHRASE)
    found = search.phrase_stats(search.scored(search.contributions(_index(spark, sf_dir), weights, terms)), terms)
    return found.select("phrase", "docs", "pairs", F.when(F.col("pairs") > 0, F.round("mean_gap", 6)).alias("mean_gap"), "common")


def phrase_boosted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, terms = parse(PHRASE)
    docs = search.boosted(search.scored(search.contributions(_index(spark, sf_dir), weights, terms)), terms)
    return _ranked(docs, "score", 20).select("doc_id", "n_phrases", "score", "rank")


def explain_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, terms = parse(QUERY)
    got = search.explain(_index(spark, sf_dir), weights, terms, DOC)
    return got.select("document_id", F.round("total_score", 6).alias("total_score"), "length", F.round("avg_doc_length", 6).alias("avg_doc_length"), F.explode("field_contributions").alias("field", "x")).withColumn("x", F.round("x", 6))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the batch, judged by labels: documents of quality 1 are relevant to every query."""
    hits = bm25_batch_topk(spark, sf_dir).where("rank <= 5").select("query_id", "doc_id", "rank")
    queries = spark.createDataFrame([(i,) for i in BATCH], "query_id int")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return evaluate.per_query(queries, hits, good.crossJoin(F.broadcast(queries)))  # four queries


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.at_five(_judged(spark, sf_dir))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


def eval_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.passes(_judged(spark, sf_dir)).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "passed")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ASKED], "term string")


def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every indexed term."""
    t = F.col("term")
    return _index(spark, sf_dir)["terms"].select("term", plural_base(t).alias("base"), plural_class(t).alias("plural_class"), F.array_join(F.array_sort(variants(t)), " ").alias("variants"))


def spell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _documents(spark, sf_dir).count()
    return correct.candidates(_asked(spark), _index(spark, sf_dir)["terms"], n).select("given", "candidate", "df", "distance", "other_class", "other_length")


def spell_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _documents(spark, sf_dir).count()
    return correct.corrections(_asked(spark), _index(spark, sf_dir)["terms"], n)


def df_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.df_summary(_index(spark, sf_dir)["terms"]).withColumn("mean_df", F.round("mean_df", 6))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_tokens(_index(spark, sf_dir), 10)


def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _index(spark, sf_dir)
    return index.integrity(_analysed(spark, sf_dir), tables["postings"], tables["terms"])


def processed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed documents, and how many break a rule of their shape."""
    analysed = _analysed(spark, sf_dir)
    broken = index.processed_violations(analysed).agg(F.count("*").alias("violations"))
    return analysed.where("doc_len > 0").agg(F.count("*").alias("documents")).crossJoin(broken)  # one row each


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.coverage(_index(spark, sf_dir)["doc_stats"], _records(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def preprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = index.report(_records(spark, sf_dir), _index(spark, sf_dir))
    return got.withColumns({c: F.round(c, 6) for c in ("success_percent", "tokens_per_doc")})


def posting_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = index.samples(_index(spark, sf_dir)["postings"], ["ther", "english", "license"])
    return got.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with faults of many kinds, made of documents by rule; some values are of types that a record must not have."""
    d = F.col("doc_id")
    typed = lambda text: F.lit(text)  # noqa: E731  a JSON value
    item = F.struct(
        F.when(d % 11 == 0, F.col("source")).otherwise(F.concat(F.lit("tt"), F.lpad((d % 900).cast("string"), 7, "0"))).alias("id"),
        F.lpad(F.col("n_chars").cast("string"), 4, "0").alias("release_year"),
        F.when(d % 3 == 0, F.lit("Rating not found.")).otherwise(((F.col("n_chars") % 100) / 10).cast("string")).alias("rating"),
        F.when(d % 4 == 0, F.lit("none")).otherwise(F.lit("$5")).alias("budget"),
        F.array(F.col("lang"), F.when(d % 6 == 0, F.col("lang")).otherwise(F.col("source"))).alias("genres"),
    )
    good = F.concat(F.lit('"https://www.imdb.com/title/tt'), F.lpad(d.cast("string"), 7, "0"), F.lit('/"'))
    links = F.concat(F.lit("["), good, F.lit(', "http://x/"'), F.when(d % 6 == 0, F.lit(', "https://www.imdb.com/name/nm1/", "https://www.imdb.com/name/nm1/"')).otherwise(""), F.lit("]"))
    others = {
        "title": F.when(d % 13 == 0, typed("5")).when(d % 5 == 0, typed('" "')).otherwise(typed('"a title"')),
        "related_links": links,
        "directors": F.when(d % 17 == 0, typed('"d"')),
        "stars": F.when(d % 19 == 0, typed('[1, "b", ""]')),
        "languages": F.when(d % 7 == 0, typed('["Languages not found."]')).when(d % 7 == 1, typed("null")),
        "reviews": F.when(d % 6 == 1, typed('"no"')).when(d % 6 == 2, typed('[["t"]]')).when(d % 6 == 3, typed('[["", "11"]]')).when(d % 6 == 4, typed('[["t", 5]]')).when(d % 6 == 5, typed('[["t", "good"], "x"]')),
    }
    more = F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), value) for name, value in others.items()))
    text = F.concat(F.regexp_replace(F.to_json(item), r"\}$", ", "), more, F.lit("}"))
    return _documents(spark, sf_dir).select(d.alias("seq"), F.parse_json(text).alias("item"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.findings(_items(spark, sf_dir))
    return found.groupBy("severity", "rule", "field").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("records"))


def findings_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.by_field(validate.findings(_items(spark, sf_dir)), validate.MISSING)


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings as the report counts them: all duplicate ids together are one error."""
    found = validate.findings(_items(spark, sf_dir))
    of = lambda severity, unique: F.count(F.when((F.col("severity") == severity) & ((F.col("rule") == "unique") == unique), 1))
    return found.agg((of(validate.ERROR, False) + F.least(of(validate.ERROR, True), F.lit(1))).alias("errors"), of(validate.WARNING, False).alias("warnings"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_ids(_items(spark, sf_dir)).select("id", "n", "seq")


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_fields(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def link_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that documents' ids link to and that aren't among the seen ones."""
    d = _documents(spark, sf_dir)
    links = F.transform(F.array(F.col("doc_id") * 2, F.col("doc_id") + 7), lambda x: F.concat(F.lit("https://www.imdb.com/title/tt"), x.cast("string"), F.lit("/")))
    seen = d.where("doc_id % 2 = 0").select(F.concat(F.lit("tt"), F.col("doc_id").cast("string")).alias("id"))
    return extract.next_frontier(d.select(links.alias("related_links")), seen)


def sub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://h/title/tt"), F.col("page_id").cast("string"), F.lit("/x"))).otherwise(F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", extract.title_id(u).alias("id"), extract.sub_page(u, "plotsummary").alias("summary_url"), extract.sub_page(u, "reviews").alias("reviews_url"))


def _titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each with the marked-up parts of a title page before it and with two sub-pages, by rule."""
    n = F.col("page_id")
    s = n.cast("string")
    made = lambda template, when=None: F.format_string(template, *([s] * template.count("%s"))) if when is None else F.when(when, F.format_string(template, *([s] * template.count("%s")))).otherwise("")
    item, label = "ipc-metadata-list-item__list-content-item", "ipc-metadata-list-item__label"
    credit = '<li data-testid="title-pc-principal-credit"><{0} class="%s">{1}</{0}>' % label
    html = F.concat(
        made("<h1> Film %s &amp; Co </h1>"),
        made('<span data-testid="plot-xl">Plot <i>of</i> %s</span>', n % 3 != 0),
        made(credit.format("span", "Director") + f'<a class="{item} x">Dir %s</a></li>'),
        made(credit.format("a", "Writers") + f'<a class="{item}">W2</a><a class="{item}">W1</a><a class="{item}">W2</a></li>', n % 2 == 0),
        made(credit.format("a", "Stars") + f'<a class="{item}">S%s</a></li>'),
        made(credit.format("a", "Star") + f'<a class="{item}">nobody</a></li>'),
        made('<section data-testid="MoreLikeThis"><a class="ipc-lockup-overlay ipc-focusable" href="/title/r%s/?x">l</a><a class="ipc-lockup-overlay other" href="/y">l</a></section>'),
        made('<div class="ipc-chip-list__scroller"><span class="ipc-chip__text">Drama</span><span class="ipc-chip__text"> </span><span class="ipc-chip__text">G%s</span></div>', n % 5 != 0),
        made('<div data-testid="hero-rating-bar__aggregate-rating__score"><span>8.%s</span><span>/10</span></div>', n % 4 == 0),
        made('<b itemprop="ratingValue"> 7.%s </b>', n % 4 == 1),
        made('<script type="application/ld+json">{"aggregateRating": {"ratingValue": 6.5}, "contentRating": "LD%s"}</script>', n % 4 == 2),
        made(f'<li class="ipc-metadata-list__item"><span class="{label}">Certificate</span><span class="{item}">C%s</span></li>', n % 4 == 0),
        made('<a href="/x/parentalguide/certificates?y">P%s</a>', n % 4 == 1),
        made('<a href="/x/releaseinfo?y">19%s</a>', n % 3 == 1),
        made(f'<li data-testid="title-details-languages"><a class="{item}">L%s</a><a class="{item}">M</a></li>', n % 3 == 2),
        made('<a href="/search?country_of_origin=US">US%s</a><a href="/search?country_of_origin=FR">FR</a>', n % 2 == 1),
        made(f'<li data-testid="title-boxoffice-budget"><span class="{item}">$%s</span></li>', n % 3 == 0),
        made('<li data-testid="title-boxoffice-budget"><b>no value</b></li>', n % 3 == 1),
        made(f'<li data-testid="title-boxoffice-cumulativeworldwidegross"><span class="{item}">$9%s</span></li>', n % 2 == 0),
        F.coalesce("html", F.lit("")),
    )
    summary = F.when(n % 7 != 0, F.format_string('<div data-testid="sub-section-summaries"><li><div class="ipc-html-content-inner-div">Sum %s &lt;1&gt;</div></li><li><div class="ipc-html-content-inner-div">two</div></li></div><div data-testid="sub-section-synopsis">Syn %s</div>', s, s))
    reviews = F.when(n % 6 != 0, F.format_string('<div class="lister-list"><div class="lister-item a"><div class="text show-more__control">Fine %s</div><span class="rating-other-user-rating"><span>8</span></span></div><div class="lister-item"></div></div>', s))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("https://h/title/p"), s, F.lit("/")).alias("url"), html.alias("html"), summary.alias("summary_html"), reviews.alias("reviews_html"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the record parser over all pages."""
    got = extract.records(_titled_pages(spark, sf_dir))
    lists = [f for f, kind in got.dtypes if kind == "array<string>"]
    reviews = F.array_join(F.transform("reviews", lambda x: F.array_join(x, "/")), "|").alias("reviews")
    return got.select(*(F.array_join(f, "|").alias(f) if f in lists else reviews if f == "reviews" else F.col(f) for f in got.columns))


QUERIES: list[Query] = [
    index_build, clean_text, tokens_long, postings, term_df, doc_lengths, index_meta, field_distribution, token_length_hist,
    bm25_topk, bm25_detail, bm25_batch_topk, query_ngrams, parsed_weights, parsed_terms, phrase_stats, sequential_phrase, phrase_boosted_topk, explain_doc,
    eval_metrics, eval_pass, plural_forms, spell_candidates, spell_best, df_summary, top_tokens, index_integrity, processed_checks,
    field_coverage, preprocess_report, posting_samples, findings, findings_by_field, validation_summary, duplicate_ids, repeated_ids,
    page_extract, link_frontier, sub_pages, page_records,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


