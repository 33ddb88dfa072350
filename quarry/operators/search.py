"""Field-weighted BM25 with phrase boosts over the postings table.

A query's terms reach the scan of the postings as literals, so that Parquet row
groups of other terms are skipped. Contributions are added in the order (query
position, field), which makes double sums reproducible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import effective, ngrams

K1, B, BOOST = 1.2, 0.75, 1.5
MAX_GAP, MEAN_GAP, LEAST_DOCS = 3, 6.0, 2

HITS = "doc_id string, doc_seq bigint, score double, detail map<string,double>, rank int"


def idf(n: Column, df: Column) -> Column:
    """May be negative: df counts (document, field) pairs."""
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, doc_len: Column, avg_dl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * (doc_len / avg_dl)))


def _weight(weights: dict[str, float]) -> Column:
    w = effective(weights)
    return reduce(lambda c, f: c.when(F.col("field") == f, F.lit(float(w[f]))), w, F.when(F.lit(False), F.lit(1.0))).otherwise(1.0)


def _added(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["score"])


def contributions(index: dict[str, DataFrame], weights: dict[str, float], query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """One row per query position and posting: qpos, term, doc_id, doc_seq, field, field_seq, tf, positions, df, idf, weight, norm, score."""
    wanted = sorted(set(query))
    places = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    posted = index["postings"].where(F.col("term").isin(wanted) if wanted else F.lit(False))
    df = index["terms"].where(F.col("term").isin(wanted) if wanted else F.lit(False)).select("term", "df")
    # df has a row for each query term and meta has one: small by construction
    rows = posted.join(F.broadcast(df), "term").crossJoin(F.broadcast(index["meta"].select(F.col("total_documents").alias("n"), "avg_dl")))
    rows = rows.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(len(query), 1) - 1)), lambda i: F.get(places, i) == F.col("term"))).alias("qpos"))
    rows = rows.withColumns({"idf": idf(F.col("n"), F.col("df")), "weight": _weight(weights), "norm": saturation(F.col("tf"), F.col("doc_len"), F.col("avg_dl"), k1, b)})
    return rows.withColumn("score", F.col("weight") * F.col("idf") * F.col("norm"))


def scored(rows: DataFrame) -> DataFrame:
    """doc_id, doc_seq, base, detail, first_qpos, places: term -> its positions in all fields, ascending."""
    parts = F.array_sort(F.collect_list(F.struct("qpos", "field_seq", "score", "term", "positions")))
    docs = rows.groupBy("doc_id", "doc_seq").agg(parts.alias("parts"))
    names = F.array_distinct(F.transform("parts", lambda x: x["term"]))
    detail = F.map_from_arrays(names, F.transform(names, lambda t: _added(F.filter("parts", lambda x: x["term"] == t))))
    # a repeated query term has its positions once
    once = lambda t: F.filter("parts", lambda x: (x["term"] == t) & (x["qpos"] == F.array_min(F.transform(F.filter("parts", lambda y: y["term"] == t), lambda y: y["qpos"]))))
    places = F.map_from_arrays(names, F.transform(names, lambda t: F.array_sort(F.flatten(F.transform(once(t), lambda x: x["positions"])))))
    return docs.select("doc_id", "doc_seq", _added(F.col("parts")).alias("base"), detail.alias("detail"), F.get("parts", F.lit(0))["qpos"].alias("first_qpos"), places.alias("places"))


def _has_all(names: Column, words: Column) -> Column:
    return F.size(F.array_except(words, names)) == 0


def _gaps(places: Column, words: Column) -> Column:
    """struct(total, pairs) of p2 - p1 - 1 over all later positions of each next word, by one walk over both words' positions."""
    steps = F.sequence(F.lit(0), F.size(words) - 2)
    at = lambda w, kind: F.transform(F.element_at(places, w), lambda p: F.struct(p.alias("p"), F.lit(kind).alias("kind")))

    def pair(acc: Column, i: Column) -> Column:
        # of equal positions the next word's is first, as it must be later
        walk = F.array_sort(F.concat(at(F.get(words, i), 1), at(F.get(words, i + 1), 0)))

        def seen(a: Column, x: Column) -> Column:
            first = x["kind"] == 1
            return F.struct(
                F.when(first, a["total"]).otherwise(a["total"] + a["n"] * (x["p"] - 1) - a["sum"]).alias("total"),
                F.when(first, a["pairs"]).otherwise(a["pairs"] + a["n"]).alias("pairs"),
                F.when(first, a["n"] + 1).otherwise(a["n"]).alias("n"),
                F.when(first, a["sum"] + x["p"]).otherwise(a["sum"]).alias("sum"),
            )

        zero = F.lit(0).cast("bigint")
        return F.aggregate(walk, F.struct(acc["total"].alias("total"), acc["pairs"].alias("pairs"), zero.alias("n"), zero.alias("sum")), seen, lambda a: F.struct(a["total"].alias("total"), a["pairs"].alias("pairs")))

    return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("pairs")), pair)


def flexible(places: Column, words: Column, most: int = MAX_GAP, exact: bool = False) -> Column:
    """Whether the words can be found in order, each at most `most` places (exactly one, if exact) after the one before."""
    after = lambda at: F.flatten(F.transform(at, lambda p: F.sequence(p + 1, p + (1 if exact else most))))
    step = lambda at, i: F.array_intersect(F.element_at(places, F.get(words, i)), after(at))
    return F.size(F.aggregate(F.sequence(F.lit(1), F.size(words) - 1), F.element_at(places, F.get(words, F.lit(0))), step)) > 0


def _phrases(query: list[str]) -> Column:
    found = ngrams(query)
    return F.array(*(F.array(*map(F.lit, p)) for p in found)) if found else F.array().cast("array<array<string>>")


def phrase_stats(docs: DataFrame, query: list[str]) -> DataFrame:
    """phrase, words, docs (that hold all words), pairs, mean_gap (infinite without pairs), common."""
    each = docs.select("places", F.explode(_phrases(query)).alias("words")).where(_has_all(F.map_keys("places"), F.col("words")))
    each = each.select("words", _gaps(F.col("places"), F.col("words")).alias("g"))
    out = each.groupBy("words").agg(F.count("*").alias("docs"), F.sum("g.total").alias("gap"), F.sum("g.pairs").alias("pairs"))
    mean = F.coalesce(F.try_divide(F.col("gap").cast("double"), F.col("pairs")), F.lit(float("inf")))
    return out.select(F.array_join("words", " ").alias("phrase"), "words", "docs", "pairs", mean.alias("mean_gap")).withColumn("common", (F.col("docs") >= LEAST_DOCS) & (F.col("mean_gap") <= MEAN_GAP))


def boosted(docs: DataFrame, query: list[str], boost: float = BOOST) -> DataFrame:
    """docs with n_phrases and score: each common phrase that fits adds base * (boost - 1)."""
    if len(query) < 2:
        return docs.withColumns({"n_phrases": F.lit(0), "score": F.col("base")})
    # at most two phrases for each query term
    common = phrase_stats(docs, query).where("common").agg(F.collect_list("words").alias("phrases"))
    fits = lambda w: F.when(_has_all(F.map_keys("places"), w), flexible(F.col("places"), w)).otherwise(F.lit(False))
    out = docs.crossJoin(F.broadcast(common)).withColumn("n_phrases", F.size(F.filter("phrases", fits))).drop("phrases")
    again = F.when(F.col("n_phrases") > 0, F.sequence(F.lit(1), F.col("n_phrases"))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("score", F.aggregate(again, F.col("base"), lambda a, _: a + F.col("base") * (boost - 1.0)))


def top(docs: DataFrame, k: int) -> DataFrame:
    """The k best; of equal scores the one found first: by query position, then by place in the corpus."""
    best = docs.orderBy(F.desc("score"), "first_qpos", "doc_seq").limit(k)
    w = Window.orderBy(F.desc("score"), "first_qpos", "doc_seq")  # over k rows
    return best.withColumn("rank", F.row_number().over(w)).select("doc_id", "doc_seq", "score", "detail", "rank")


def search(spark: SparkSession, index: dict[str, DataFrame], weights: dict[str, float], query: list[str], k: int = 5, k1: float = K1, b: float = B, boost: float = BOOST) -> DataFrame:
    """HITS of a parsed query."""
    if not query:
        return spark.createDataFrame([], HITS)
    return top(boosted(scored(contributions(index, weights, query, k1, b)), query, boost), k)


#: Distinct terms of a batch that are sent as literals, so that only their row groups are read; more are joined.
LITERALS = 5000


def batch_search(index: dict[str, DataFrame], queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """Unboosted hits of many queries(query_id, weights map, terms array) at once: query_id, doc_id, doc_seq, score (rounded, if digits are given), rank."""
    asked = queries.select("query_id", "weights", F.posexplode("terms").alias("qpos", "term"))
    posted, terms = index["postings"], index["terms"].select("term", "df")
    wanted = [r[0] for r in asked.select("term").distinct().limit(LITERALS + 1).collect()]
    if len(wanted) <= LITERALS:
        some = F.col("term").isin(wanted) if wanted else F.lit(False)
        posted, terms = posted.where(some), F.broadcast(terms.where(some))
    rows = asked.join(terms, "term").join(posted, "term").crossJoin(F.broadcast(index["meta"].select(F.col("total_documents").alias("n"), "avg_dl")))
    given = F.coalesce(F.try_element_at("weights", "field"), F.lit(1.0))
    weight = F.when(given <= 0, 0.01).otherwise(given)
    rows = rows.withColumn("score", weight * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("doc_len"), F.col("avg_dl"), k1, b))
    parts = F.array_sort(F.collect_list(F.struct("qpos", "field_seq", "score")))
    docs = rows.groupBy("query_id", "doc_id", "doc_seq").agg(parts.alias("parts"))
    total = _added(F.col("parts")) if digits is None else F.round(_added(F.col("parts")), digits)
    docs = docs.select("query_id", "doc_id", "doc_seq", total.alias("score"), F.get("parts", F.lit(0))["qpos"].alias("first_qpos"))
    # the limit on the rank reaches below the exchange: each task sends its k best of a query
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_qpos", "doc_seq")
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first_qpos")


def explain(index: dict[str, DataFrame], weights: dict[str, float], query: list[str], doc_id: str) -> DataFrame:
    """One row on one document, unboosted: total, the last posting of each term, sums by field, lengths."""
    one = {**index, "postings": index["postings"].where(F.col("doc_id") == doc_id)}
    rows = contributions(one, weights, query)
    part = F.struct("qpos", "field_seq", "term", "field", "score", "tf", "idf", F.col("weight").alias("field_weight"), F.col("norm").alias("normalized_tf"))
    got = rows.agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("doc_len").alias("len"))
    names, fields = F.array_distinct(F.transform("parts", lambda x: x["term"])), F.array_distinct(F.transform("parts", lambda x: x["field"]))
    last = F.transform(names, lambda t: F.element_at(F.filter("parts", lambda x: x["term"] == t), -1))
    sums = F.transform(fields, lambda f: _added(F.filter("parts", lambda x: x["field"] == f)))
    length = one["doc_stats"].where(F.col("doc_id") == doc_id).agg(F.coalesce(F.max("doc_len"), F.lit(0)).alias("length"))
    return got.crossJoin(length).crossJoin(index["meta"].select("avg_dl")).select(
        F.lit(doc_id).alias("document_id"), _added(F.col("parts")).alias("total_score"),
        F.map_from_arrays(names, last).alias("token_contributions"), F.map_from_arrays(fields, sums).alias("field_contributions"),
        "length", F.col("avg_dl").alias("avg_doc_length"),
    )
