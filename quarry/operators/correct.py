"""Spelling correction of query terms against the terms table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import COMMON_WORDS, parse, plural_base, plural_class, variants


def reasonable_df(df: Column, n: Column) -> Column:
    """Words rarer than this never replace a term."""
    return df >= F.floor(F.greatest(F.lit(2.0), n * 0.002))


def prepared(asked: DataFrame) -> DataFrame:
    """asked(term): lower-cased and stripped, with look (without hyphens) and plain (left alone)."""
    out = asked.select(F.col("term").alias("given"), F.trim(F.lower("term")).alias("term")).distinct().withColumn("look", F.replace("term", F.lit("-"), F.lit("")))
    plain = (F.col("term") == "") | F.col("term").isin(sorted(COMMON_WORDS)) | F.col("look").rlike(r"^\p{N}+$") | (F.length("look") <= 2)
    return out.withColumn("plain", plain)


def candidates(asked: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Words within reach of each term: the same first letter, two in length, an edit distance of 1 (2 below five letters).

    The first letter joins by hash; the bounded distance is only computed for
    words that pass the length and frequency tests.
    """
    left = prepared(asked).where("not plain and look <> ''").withColumn("first", F.left("look", F.lit(1)))
    right = terms.where(reasonable_df(F.col("df"), F.lit(float(n)))).select(F.col("term").alias("candidate"), "df", F.left("term", F.lit(1)).alias("first"))
    most = F.when(F.length("look") >= 5, 1).otherwise(2)
    near = left.join(right, "first").where(F.abs(F.length("candidate") - F.length("look")) <= 2)
    near = near.withColumn("distance", F.expr("levenshtein(look, candidate, 2)")).where((F.col("distance") >= 0) & (F.col("distance") <= most))
    return near.select(
        "given", "term", "look", "candidate", "df", "distance",
        (plural_class(F.col("candidate")) != plural_class(F.col("look"))).cast("int").alias("other_class"),
        (F.length("candidate") != F.length("look")).cast("int").alias("other_length"),
    )


def corrections(asked: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(given, corrected, rule) of each term; the first rule that fits counts."""
    base = prepared(asked)
    words = terms.select("term", "df")
    known = words.select(F.col("term").alias("word"), F.lit(True).alias("yes"))
    out = base.join(known.select(F.col("word").alias("term"), F.col("yes").alias("has_term")), "term", "left")
    out = out.join(known.select(F.col("word").alias("look"), F.col("yes").alias("has_look")), "look", "left")
    out = out.withColumn("base", plural_base(F.col("look"))).join(known.select(F.col("word").alias("base"), F.col("yes").alias("has_base")), "base", "left")
    forms = base.select("given", F.explode(variants(F.col("look"))).alias("form")).join(words.select(F.col("term").alias("form"), "df"), "form")
    forms = forms.groupBy("given").agg(F.min_by("form", F.struct((-F.col("df")).alias("d"), "form")).alias("variant"))
    near = candidates(asked, terms, n).groupBy("given").agg(F.min_by("candidate", F.struct("distance", "other_class", "other_length", (-F.col("df")).alias("d"), "candidate")).alias("nearest"))
    out = out.join(forms, "given", "left").join(near, "given", "left")
    rule = (
        F.when(F.col("plain"), "plain").when(F.col("has_term"), "known").when(F.col("has_look"), "joined").when(F.col("has_base"), "plural")
        .when(F.col("variant").isNotNull(), "variant").when(F.col("nearest").isNotNull(), "nearest").otherwise("unknown")
    )
    out = out.withColumn("rule", rule)
    word = F.when(F.col("rule") == "joined", F.col("look")).when(F.col("rule") == "variant", F.col("variant")).when(F.col("rule") == "nearest", F.col("nearest")).otherwise(F.col("term"))
    return out.select("given", word.alias("corrected"), "rule")


def parse_corrected(spark: SparkSession, query: str | None, terms: DataFrame, n: int) -> tuple[dict[str, float], list[str]]:
    """parse(query) with its terms corrected in one job."""
    found: list[str] = []
    parse(query, lambda t: found.append(t) or t)
    if not found:
        return parse(query)
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(found)], "term string")
    fixed = {r[0]: r[1] for r in corrections(asked, terms, n).collect()}  # a row for each query term
    return parse(query, fixed.__getitem__)
