"""The command line: crawl, preprocess, build, search, validate, grade."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import parse
from ..operators import correct, evaluate, extract, index, search, validate
from ..sources import http
from ..sources.records import RECORD, from_documents, json_is_list, read_index, read_json, read_records, write_index, write_json, write_tokens_json

# Fixed value: the page whose list a crawl starts from.
CHART = f"{extract.HOST}/chart/top/"
FRONTIER = "url string, id string"


def session(name: str = "quarry") -> SparkSession:
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, of a crawl's folder of JSON lines, or of a documents table in Parquet."""
    if path.endswith(".json"):
        return read_records(spark, path)
    if path.endswith(".parquet"):
        return from_documents(spark.read.parquet(path))
    return read_json(spark, f"{path}/crawled", f"{RECORD}, seq bigint").where("id <> ''")


def crawl(spark: SparkSession, target: str, limit: int = 1000, fetch: Callable[[DataFrame], DataFrame] | None = None, chart: DataFrame | None = None) -> int:
    """Adds up to `limit` asked-for titles to the records in target/crawled, and writes what is left of the queue to target/remaining. Gives the number of records.

    A crawl that was stopped goes on from there; a new one starts from the titles of chart(html).
    """
    done = read_json(spark, f"{target}/crawled", f"{RECORD}, seq bigint")
    queue = read_json(spark, f"{target}/remaining", FRONTIER)
    before = done.count()
    seen = done.select("id").unionByName(queue.select("id")) if before or not queue.isEmpty() else None
    turn = [0]

    def keep(df: DataFrame, _: int) -> DataFrame:
        turn[0] += 1
        path = f"{target}/rounds/{turn[0]}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    if seen is None:
        if chart is None:
            chart = http.fetch(spark.createDataFrame([(CHART, "")], FRONTIER), sub_pages=False).select("html")
        queue = extract.seeds(chart)
    got, left = extract.crawl(spark, fetch or http.fetch, queue, limit, keep, seen)
    got.withColumn("seq", F.monotonically_increasing_id() + before).write.mode("append").option("ignoreNullFields", "false").json(f"{target}/crawled")
    write_json(left, f"{target}/remaining")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/rounds")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return read_json(spark, f"{target}/crawled", f"{RECORD}, seq bigint").count()


def crawl_or_load(spark: SparkSession, source: str, min_count: int, crawl_first: bool = False, limit: int = 1000, **how) -> str:
    """Why the records at source can't be used, or the empty string. Only crawl_first crawls; without it they must be there."""
    if crawl_first:
        crawl(spark, source, limit, **how)
    if source.endswith(".json"):
        if not _exists(spark, source):
            return f"{source} not found"
        try:
            if not json_is_list(spark, source):
                return "top level is not a list"
        except Exception as e:  # noqa: BLE001  no JSON at all
            return f"not readable: {str(e).splitlines()[0][:200]}"
    elif not _exists(spark, source if source.endswith(".parquet") else f"{source}/crawled"):
        return f"{source} not found"
    n = load(spark, source).count()
    return "" if n >= min_count else f"{n} records, {min_count} expected"


def preprocess(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Writes the processed tokens as JSON lines; keeps ones that are there unless forced. Returns whether it wrote."""
    if not force and _exists(spark, f"{target}/_SUCCESS"):
        return False
    write_tokens_json(index.field_tokens(load(spark, source)), target)
    return True


def build(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Writes the index; keeps one that is there unless forced. Returns whether it wrote."""
    if not force and _exists(spark, f"{target}/meta/_SUCCESS"):
        return False
    write_index(index.build(load(spark, source)), target)
    return True


def run_query(spark: SparkSession, tables: dict[str, DataFrame], query: str, k: int = 5) -> DataFrame:
    n = tables["meta"].first()["total_documents"]
    weights, terms = correct.parse_corrected(spark, query, tables["terms"], n)
    return search.search(spark, tables, weights, terms, k)


def grade(spark: SparkSession, tables: dict[str, DataFrame], judged: list[tuple[str, list[str]]], k: int = 5) -> dict[str, float]:
    """Both sets of measures over (query, relevant ids)."""
    hits = None
    for i, (query, _) in enumerate(judged):
        one = run_query(spark, tables, query, k).select(F.lit(i).alias("query_id"), "doc_id", "rank")
        hits = one if hits is None else hits.unionByName(one)
    queries = spark.range(len(judged)).select(F.col("id").cast("int").alias("query_id"))
    qrels = spark.createDataFrame([(i, d) for i, (_, ids) in enumerate(judged) for d in ids], "query_id int, doc_id string")
    measured = evaluate.per_query(queries, hits, qrels).persist()
    out = evaluate.at_five(measured).first().asDict() | evaluate.macro(evaluate.passes(measured)).first().asDict()
    measured.unpersist()
    return out


# Queries whose parse is known, as (query, weights that are set, terms).
PARSED = [
    ("title:0 genres:1 stars:0 summaries:0 noir thriller", {"title": 0.0, "genres": 1.0, "stars": 0.0, "summaries": 0.0}, "noir thriller"),
    ("summary:0.4 drama", {"summaries": 0.4}, "drama"),
    ("stars:-1 title:2 prison", {"stars": 0.0, "title": 2.0}, "prison"),
]


def parser_faults() -> list[str]:
    """Queries that are not parsed as they must be."""
    out = []
    for query, want, terms in PARSED:
        weights, words = parse(query)
        if " ".join(words) != terms or any(abs(weights[f] - want.get(f, 1.0)) > 1e-6 for f in weights):
            out.append(query)
    return out


def grade_all(spark: SparkSession, source: str, work: str, judged: list[tuple[str, list[str]]], min_count: int = 900, force_preprocess: bool = False, force_index: bool = False, k: int = 5, threshold: float = 0.8, say: Callable[[str], None] = print, **crawling) -> bool:
    """Runs and checks all stages, on all their rows; whether all passed. A stage that fails doesn't stop the others."""
    passed = []

    def stage(name: str, run: Callable[[], str]) -> None:
        try:
            fault = run()
        except Exception as e:  # noqa: BLE001  a fault of one stage is its grade
            fault = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
        passed.append(not fault)
        say(f"{'ok' if not fault else 'FAILED'}  {name}{': ' + fault if fault else ''}")

    def tokens() -> str:
        preprocess(spark, source, f"{work}/tokens", force_preprocess)
        analysed = index.field_tokens(load(spark, source))
        bad = index.processed_violations(analysed).groupBy("rule").count().collect()  # a row a rule
        return "; ".join(f"{r['rule']}: {r['count']}" for r in bad) or ("" if not analysed.where("doc_len > 0").isEmpty() else "no tokens")

    def indexed() -> str:
        build(spark, source, f"{work}/index", force_index)
        tables = read_index(spark, f"{work}/index")
        r = index.integrity(index.field_tokens(load(spark, source)), tables["postings"], tables["terms"]).first()
        return "" if not any(r) else f"{r['missing_docs']} documents missing, {r['df_errors']} df and {r['tf_errors']} tf wrong"

    def searched() -> str:
        if not any(ids for _, ids in judged):
            say("    no judged queries: no measures")
            return ""
        got = grade(spark, read_index(spark, f"{work}/index"), judged, k)
        say("    " + ", ".join(f"{name} {value:.4g}" for name, value in got.items()))
        return "" if max(got["macro_precision"] or 0.0, got["macro_recall"] or 0.0) >= threshold else f"neither macro measure reaches {threshold}"

    stage("crawl or load", lambda: crawl_or_load(spark, source, min_count, **crawling))
    stage("preprocess", tokens)
    stage("index", indexed)
    stage("query parser", lambda: "; ".join(parser_faults()))
    stage("search", searched)
    say("PASS" if all(passed) else "FAIL")
    return all(passed)


def main(argv: list[str] | None = None) -> int:
    """0 done or passed, 1 failed, 2 warnings where they count as failures, or a wrong command."""
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("crawl", help="records of titles, from the chart or on from where the last crawl stopped")
    c.add_argument("target")
    c.add_argument("--limit", type=int, default=1000)
    t = sub.add_parser("preprocess", help="processed tokens as JSON")
    b = sub.add_parser("build", help="the index")
    for x, name in ((t, "tokens"), (b, "index")):
        x.add_argument("source")
        x.add_argument(name)
        x.add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--k", type=int, default=5)
    v = sub.add_parser("validate")
    v.add_argument("json_file")
    v.add_argument("--min-count", type=int, default=10)
    v.add_argument("--fail-on-warning", action="store_true")
    g = sub.add_parser("grade", help="runs and checks all stages")
    g.add_argument("source")
    g.add_argument("work")
    g.add_argument("--judged", help="JSON: [[query, [relevant ids]], ...]")
    g.add_argument("--crawl", action="store_true")
    g.add_argument("--limit", type=int, default=1000)
    g.add_argument("--min-count", type=int, default=900)
    g.add_argument("--force-preprocess", action="store_true")
    g.add_argument("--force-index", action="store_true")
    g.add_argument("--k", type=int, default=5)
    a = p.parse_args(argv)
    spark = session()
    if a.job == "crawl":
        print(crawl(spark, a.target, a.limit), "records")
    elif a.job == "preprocess":
        print("written" if preprocess(spark, a.source, a.tokens, a.force) else "there already")
    elif a.job == "build":
        print("written" if build(spark, a.source, a.index, a.force) else "there already")
    elif a.job == "validate":
        return validate.validate(spark, a.json_file, a.min_count, a.fail_on_warning)
    elif a.job == "grade":
        judged = []
        if a.judged:
            with open(a.judged, encoding="utf-8") as f:
                judged = [(q, list(ids)) for q, ids in json.load(f)]
        return 0 if grade_all(spark, a.source, a.work, judged, a.min_count, a.force_preprocess, a.force_index, a.k, crawl_first=a.crawl, limit=a.limit) else 1
    else:
        run_query(spark, read_index(spark, a.index), a.query, a.k).show(a.k, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
