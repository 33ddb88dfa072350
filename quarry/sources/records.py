"""Records: readers and writers of the JSON forms and of the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FIELDS

TEXT_FIELDS = "id title first_page_summary release_year mpaa budget gross_worldwide rating".split()
LIST_FIELDS = "directors writers stars related_links genres languages countries_of_origin summaries synopsis".split()
#: The 18 fields of a record.
RECORD = ", ".join([*(f"{c} string" for c in TEXT_FIELDS), *(f"{c} array<string>" for c in LIST_FIELDS), "reviews array<array<string>>"])
TOKENS_JSON = "map<string,map<string,array<string>>>"
INDEX_JSON = (
    "struct<metadata:struct<indexed_fields:array<string>,total_documents:bigint,total_tokens:bigint,unique_tokens:bigint,index_date:string,"
    "field_distribution:map<string,bigint>,token_length_distribution:map<string,bigint>>,"
    "index:map<string,struct<df:bigint,postings:array<struct<doc_id:string,tf:int,positions:array<int>,field:string>>>>>"
)
METADATA = "indexed_fields total_documents total_tokens unique_tokens index_date field_distribution token_length_distribution".split()
TABLES = ("postings", "terms", "doc_stats", "meta")
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


def empty_record(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple([None] * 18)], RECORD)


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(seq, item variant) of a JSON file whose top level is an array; no rows for any other value.

    A top-level array is one JSON value, so a file is parsed as a whole; give
    large corpora as many files, or as JSON lines.
    """
    spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v")).createOrReplaceTempView("_quarry_json")
    return spark.sql("SELECT cast(e.pos AS bigint) AS seq, e.value AS item FROM _quarry_json, LATERAL variant_explode(v) AS e WHERE schema_of_variant(v) LIKE 'ARRAY%'")


def json_is_list(spark: SparkSession, path: str) -> bool:
    kinds = spark.read.text(path, wholetext=True).select(F.expr("schema_of_variant(parse_json(value)) like 'ARRAY%'")).collect()
    return bool(kinds) and all(r[0] for r in kinds)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with seq, from a JSON array; items that are no objects, and ids that are missing or empty, are skipped."""
    items = json_items(spark, path).where("schema_of_variant(item) like 'OBJECT%'")
    return items.select("seq", F.from_json(F.to_json("item"), f"struct<{RECORD.replace(' ', ':').replace(',:', ',')}>").alias("r")).select("seq", "r.*").where("id <> ''")


def from_documents(documents: DataFrame) -> DataFrame:
    """Records of the documents table: first line, rest, language name and source as the four fields."""
    at = F.instr("text", "\n")
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("seq"),
        F.when(at > 0, F.left("text", at - 1)).otherwise(F.col("text")).alias("title"),
        F.when(at > 0, F.array(F.col("text").substr(at + 1, F.length("text")))).alias("summaries"),
        F.array(names[F.col("lang")]).alias("genres"),
        F.array(F.concat(F.lit("source "), F.lpad(number, 4, "0"))).alias("stars"),
    )


def read_tokens_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, field, tokens) from {doc: {field: [token]}}."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TOKENS_JSON)).alias("doc_id", "fields"))
    return docs.select("doc_id", F.explode("fields").alias("field", "tokens"))


def write_index(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The four tables, from one pass over the postings' source.

    Postings are written as they come, and all else is read from there: sorted by
    term and document, so that a search reads few row groups and a frequent term is
    dealt over several tasks; terms with their counts; documents with their length
    and fields; and one row of metadata.
    """
    spark, raw = postings.sparkSession, f"{path}/_raw"
    postings.write.mode("overwrite").parquet(raw)
    posted = spark.read.schema(postings.schema).parquet(raw)
    posted.repartitionByRange("term", "doc_seq").sortWithinPartitions("term", "doc_seq", "field_seq").write.mode(mode).parquet(f"{path}/postings")
    terms = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    # four fields at most
    docs = posted.groupBy("doc_id", "doc_seq").agg(F.sum("tf").alias("doc_len"), F.sort_array(F.collect_set("field")).alias("fields"))
    docs.write.mode(mode).parquet(f"{path}/doc_stats")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(raw)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    index_meta(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/doc_stats")).write.mode(mode).parquet(f"{path}/meta")


def index_meta(terms: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """One row of index metadata, from the terms and the documents."""

    def as_map(df: DataFrame, k: str, v: str, name: str) -> DataFrame:  # a few rows
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k), F.col(v))))).alias(name))

    docs = doc_stats.agg(F.count("*").alias("total_documents"), F.coalesce(F.avg("doc_len"), F.lit(1.0)).alias("avg_dl"))
    counts = terms.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_tokens"))
    fields = as_map(doc_stats.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("docs")), "field", "docs", "field_distribution")
    lengths = terms.groupBy(F.length("term").cast("string").alias("token_length")).agg(F.sum("occurrences").alias("n"))
    lengths = as_map(lengths, "token_length", "n", "token_length_distribution")
    return (
        docs.crossJoin(counts).crossJoin(fields).crossJoin(lengths)  # four rows
        .withColumns({"indexed_fields": F.array(*map(F.lit, FIELDS)), "index_date": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")})
    )


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """terms(term, df); empty where there is none to read."""
    try:
        return spark.read.parquet(f"{path}/terms").select("term", "df")
    except Exception:  # noqa: BLE001  correction then has no words and leaves all terms alone
        return spark.createDataFrame([], "term string, df bigint")


def write_tokens_json(analysed: DataFrame, path: str) -> None:
    """Tokens as JSON lines, each {doc: {field: [token]}}; documents without a token are left out. Files appear when all are written."""
    fields = F.map_from_entries(F.transform("fields", lambda x: F.struct(x["field"].alias("k"), x["tokens"].alias("v"))))
    lines = analysed.where(F.size("fields") > 0).select(F.to_json(F.create_map("doc_id", fields)).alias("value"))
    lines.write.mode("overwrite").text(path)


def index_entries(tables: dict[str, DataFrame], chunk: int = 1000) -> DataFrame:
    """(term, part, df, postings) rows in the JSON form's shape and order; no row has more than `chunk` postings."""
    ranked = tables["postings"].select("*", F.floor(F.row_number().over(Window.partitionBy("term").orderBy("doc_seq", "field_seq")) / F.lit(chunk + 0.5)).alias("part"))
    entry = F.struct("doc_seq", "field_seq", F.struct("doc_id", "tf", "positions", "field").alias("p"))
    rows = ranked.groupBy("term", "part").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["p"]).alias("postings"))
    return rows.join(tables["terms"].select("term", "df"), "term").select("term", "part", "df", "postings")


def write_index_json(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines: one {"metadata": {...}}, and {"index": {term: {df, postings}}} with a part of a term's postings each; valid for an empty index, too."""
    meta = tables["meta"].select(F.to_json(F.struct(F.struct(*(tables["meta"][c] for c in METADATA)).alias("metadata"))).alias("value"))
    entry = F.create_map("term", F.struct("df", "postings"))
    entries = index_entries(tables).select(F.to_json(F.struct(entry.alias("index"))).alias("value"))
    meta.unionByName(entries).write.mode("overwrite").text(path)


def _index_json(spark: SparkSession, path: str) -> DataFrame:
    """The parsed objects: lines as written here, or one file with a single object over many lines."""
    kind = F.from_json("value", INDEX_JSON)
    by_line = spark.read.text(path).where("trim(value) <> ''").select(kind.alias("x"))
    whole = by_line.where("x is null or (x.metadata is null and x.index is null)").limit(1).count() > 0
    return spark.read.text(path, wholetext=True).select(kind.alias("x")) if whole else by_line


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings (term, doc_id, tf, positions, field) from the JSON form. A missing file and text that is no such object raise."""
    found = _index_json(spark, path)
    if found.where("x is null or (x.metadata is null and x.index is null)").limit(1).count():
        raise ValueError(f"no index in {path}")
    terms = found.select(F.explode("x.index").alias("term", "entry"))
    return terms.select("term", F.explode("entry.postings").alias("p")).select("term", "p.*")


def read_index_json_metadata(spark: SparkSession, path: str) -> DataFrame:
    return _index_json(spark, path).where("x.metadata is not null").select("x.metadata.*")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, by as many tasks as there are; nulls are written, so that a record keeps all its keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """What write_json wrote; no rows where there is nothing yet, so that a crawl can start anew."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
