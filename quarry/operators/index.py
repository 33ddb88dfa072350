"""Analysis and the positional index, as DataFrame tables.

tokens(doc_id, doc_seq, doc_len, field, field_seq, pos, term) -> postings, and from these, once stored, terms, doc_stats, meta.
A document's length is known while its row is analysed; postings carry it, so
that scoring needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIELDS, clean, flattened, has_placeholder, tokens


def _analysed(x: Column) -> Column:
    found = F.when(~has_placeholder(x["text"]), tokens(clean(x["text"])))
    return F.struct(x["field"].alias("field"), x["field_seq"].alias("field_seq"), F.coalesce(found, F.array().cast("array<string>")).alias("tokens"))


def field_tokens(records: DataFrame, unique_ids: bool = False) -> DataFrame:
    """(doc_id, doc_seq, doc_len, fields array<struct<field, field_seq, tokens>>); a document without a token has length 0.

    Of records with one id the last that has tokens counts, at the place of the
    first that has. unique_ids spares the exchange that this takes. Documents
    of length 0 stay in: a filter here would have Catalyst analyse each text twice.
    """
    texts, kinds = [], dict(records.dtypes)
    for i, name in enumerate(FIELDS):
        text = flattened(F.col(name), " " if name == "summaries" else ", ") if kinds[name].startswith("array") else F.col(name)
        texts.append(F.struct(F.lit(name).alias("field"), F.lit(i).alias("field_seq"), F.coalesce(text, F.lit("")).alias("text")))
    fields = F.filter(F.transform(F.array(*texts), _analysed), lambda x: F.size(x["tokens"]) > 0)
    rows = records.where("id is not null and id <> ''").select(F.col("id").cast("string").alias("doc_id"), F.col("seq").alias("doc_seq"), fields.alias("fields"))
    if not unique_ids:
        place = F.when(F.size("fields") > 0, F.col("doc_seq"))
        rows = rows.groupBy("doc_id").agg(F.coalesce(F.max_by("fields", place), F.first("fields")).alias("fields"), F.min(place).alias("doc_seq"))
    return rows.select("doc_id", "doc_seq", F.aggregate("fields", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["tokens"])).alias("doc_len"), "fields")


def tokens_long(analysed: DataFrame) -> DataFrame:
    # the outer form, as the inner one makes Catalyst put a filter on the analysis below
    one = analysed.select("doc_id", "doc_seq", "doc_len", F.explode_outer("fields").alias("f"))
    return one.select("doc_id", "doc_seq", "doc_len", "f.field", "f.field_seq", F.posexplode("f.tokens").alias("pos", "term"))


def postings(long: DataFrame) -> DataFrame:
    keys = ["term", "doc_id", "doc_seq", "doc_len", "field", "field_seq"]
    return long.groupBy(keys).agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def occurrences(posted: DataFrame) -> DataFrame:
    """postings with one row a position: the tokens again."""
    return posted.select("*", F.explode("positions").alias("pos"))


def field_distribution(doc_stats: DataFrame) -> DataFrame:
    """Documents with each field."""
    return doc_stats.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("docs"))


def token_lengths(terms: DataFrame) -> DataFrame:
    return terms.groupBy(F.length("term").alias("token_length")).agg(F.sum("occurrences").alias("occurrences"))


def build(records: DataFrame, unique_ids: bool = False) -> DataFrame:
    """The postings of records, from which write_index derives all tables."""
    return postings(tokens_long(field_tokens(records, unique_ids)))


def df_summary(term_df: DataFrame) -> DataFrame:
    """Least, largest, mean and upper median df.

    The median comes from the counts of each df, whose number is bounded by the
    number of distinct counts, not of terms.
    """
    steps = term_df.groupBy("df").agg(F.count("*").alias("c"))
    w = Window.orderBy("df")
    run = steps.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg(
        F.min("df").alias("min_df"), F.max("df").alias("max_df"),
        F.try_divide(F.sum(F.col("df") * F.col("c")).cast("double"), F.sum("c")).alias("mean_df"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("df"))).alias("median_df"),
    )


def top_tokens(index: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The commonest terms; of equal ones the one that occurs first.

    Only terms as frequent as the k-th are looked up in the postings; the k-th
    count comes from the counts, whose number is bounded by the distinct ones.
    """
    counts = index["terms"].groupBy("occurrences").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("occurrences"))))
    least = upto.where(F.col("upto") - F.col("c") < k).agg(F.min("occurrences").alias("least"))
    often = index["terms"].join(F.broadcast(least), F.col("occurrences") >= F.col("least")).select("term", F.col("occurrences").alias("freq"))
    first = F.min(F.struct("doc_seq", "field_seq", F.get("positions", F.lit(0)).alias("pos"))).alias("first")
    return index["postings"].join(often, "term").groupBy("term", "freq").agg(first).orderBy(F.desc("freq"), "first").limit(k).select("term", "freq")


def coverage(doc_stats: DataFrame, records: DataFrame) -> DataFrame:
    """Documents with each field, and their percentage of all raw records."""
    total = records.agg(F.count("*").alias("total"))
    return field_distribution(doc_stats).crossJoin(total).select("field", "docs", F.coalesce(F.try_divide(F.col("docs") * 100.0, "total"), F.lit(0.0)).alias("percent"))


def integrity(analysed: DataFrame, posted: DataFrame, term_df: DataFrame) -> DataFrame:
    """One row of the index checks: documents not indexed, terms whose df or tf disagree with their postings."""
    missing = analysed.where("doc_len > 0").select("doc_id").join(posted.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("missing_docs"))
    counted = posted.groupBy("term").agg(F.count("*").alias("n"), F.sum((F.col("tf") != F.size("positions")).cast("bigint")).alias("bad_tf"))
    wrong = counted.join(term_df, "term", "full").agg(F.sum((~F.coalesce(F.col("n") == F.col("df"), F.lit(False))).cast("bigint")).alias("df_errors"), F.sum("bad_tf").alias("tf_errors"))
    return missing.crossJoin(wrong)


def processed_violations(analysed: DataFrame) -> DataFrame:
    """(doc_id, rule) of processed documents of the wrong shape: no id, unknown or repeated field, an empty or blank token, a length that isn't the tokens' number."""
    names = F.transform("fields", lambda x: x["field"])
    tokens = F.flatten(F.transform("fields", lambda x: x["tokens"]))
    rules = {
        "no id": F.coalesce(F.col("doc_id") == "", F.lit(True)),
        "unknown field": F.size(F.array_except(names, F.array(*map(F.lit, FIELDS)))) > 0,
        "repeated field": F.size(F.array_distinct(names)) < F.size(names),
        "blank token": F.exists(tokens, lambda t: F.coalesce(F.trim(t) == "", F.lit(True))),
        "length": F.col("doc_len") != F.size(tokens),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return analysed.select("doc_id", F.explode(found).alias("rule"))


def report(records: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """One row of the preprocessing report's figures; 0 where there is nothing to divide by."""
    both = records.agg(F.count("*").alias("raw")).crossJoin(index["meta"].select(F.col("total_documents").alias("processed"), "total_tokens", "unique_tokens"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("raw", "processed", rate(F.col("processed") * 100.0, F.col("raw")).alias("success_percent"), "total_tokens", "unique_tokens", rate(F.col("total_tokens") * 1.0, F.col("processed")).alias("tokens_per_doc"))


def samples(posted: DataFrame, wanted: list[str], postings_each: int = 3, positions_each: int = 3) -> DataFrame:
    """Up to three postings, with up to three positions, of each wanted term."""
    w = Window.partitionBy("term").orderBy("doc_seq", "field_seq")
    ranked = posted.where(F.col("term").isin(wanted)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= postings_each)
    return ranked.select("term", "n", "doc_id", "field", "tf", F.slice("positions", 1, positions_each).alias("positions"))
