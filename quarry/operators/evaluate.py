"""Two sets of retrieval measures. hits(query_id, doc_id, rank), qrels(query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(queries: DataFrame, hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, retrieved, relevant_hits, judged (rows), relevant (distinct), first_rank."""
    good = qrels.select("query_id", "doc_id").distinct()
    got = hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("retrieved"))
    match = hits.join(good, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant_hits"), F.min("rank").alias("first_rank"))
    known = qrels.groupBy("query_id").agg(F.count("*").alias("judged"), F.countDistinct("doc_id").alias("relevant"))
    out = queries.select("query_id").distinct().join(got, "query_id", "left").join(match, "query_id", "left").join(known, "query_id", "left")
    return out.fillna(0, ["retrieved", "relevant_hits", "judged", "relevant"])


def at_five(measured: DataFrame) -> DataFrame:
    """One row: mean precision (of five places, always), recall (of the judged list) and reciprocal rank."""
    each = measured.select(
        (F.col("relevant_hits") / 5.0).alias("p"),
        F.coalesce(F.try_divide(F.col("relevant_hits") * 1.0, "judged"), F.lit(0.0)).alias("r"),
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("rr"),
    )
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(mean("p").alias("precision_at_5"), mean("r").alias("recall_at_5"), mean("rr").alias("mrr"))


def passes(measured: DataFrame, threshold: float = 0.8) -> DataFrame:
    """query_id, precision (of what was retrieved), recall (of distinct relevant), passed if either reaches the threshold."""
    p = F.col("relevant_hits") / F.greatest(F.lit(1), "retrieved")
    r = F.col("relevant_hits") / F.greatest(F.lit(1), "relevant")
    return measured.select("query_id", p.alias("precision"), r.alias("recall"), ((p >= threshold) | (r >= threshold)).alias("passed"))


def macro(passed: DataFrame) -> DataFrame:
    return passed.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.coalesce(F.sum(F.col("passed").cast("bigint")), F.lit(0)).alias("n_passed"), F.count("*").alias("n_queries"))
