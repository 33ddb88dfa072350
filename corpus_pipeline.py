"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet and reads it again as the next one's docs. All but the last return
the columns of documents.

Defined cases: rows are told apart by doc_id, and those without one by their
text, so each of them is judged as its text is; of rows that share an id but not
the text, all are kept or dropped together; of rows that repeat both, the near
duplicates' stage keeps one. A null or empty text fails the quality rules. Of
equal documents the smallest doc_id stays (ties). Very long texts are read
whole. Empty tables pass through, and an empty benchmark drops nothing. Other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, packing, quality, secrets
from quarry.llm.store import latest, scope, written


def _key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.lit("no id"), docs["text"]))


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs, all with a doc_id."""
    return docs.withColumn("doc_id", _key(docs))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't among gone(doc_id)."""
    gone = gone.select("doc_id").distinct()
    return docs.join(gone, _key(docs) == gone["doc_id"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _without(docs, quality.rated(spark, _told_apart(docs)).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, 0.8 (op6's own three words and 0.9 are for that query only)."""
    apart = _told_apart(docs)
    groups = jaccard.similar(spark, apart, words=5, percent=80)
    kept = _without(docs, groups.where("doc_id <> component_id"))
    if apart.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    # repeated rows have the same id and text: a copy of each is left
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("rest")) if rest else kept.distinct()
    return one.select(*(F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    hits = decontaminate.overlap(spark, _told_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, hits.where("n_hit > 0"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret masked; n_chars follows the text."""
    whole = docs.select(F.struct("*").alias("doc"), "text", *[c for c in ("source",) if c in docs.columns])  # names of docs can't clash then
    scanned = secrets.found(spark, whole)
    changed = {"text": secrets.masked(F.col("text"), F.col("secrets"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("secrets") > 0, F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    return scanned.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in the training sequences."""
    return packing.pack(spark, docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the forest nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        with scope(spark, last):  # what a stage wrote on its way goes, and so does its input
            docs = written(spark, stage(spark, docs, sf_dir), name)
        last = latest()
    return docs
