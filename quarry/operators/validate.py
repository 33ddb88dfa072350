"""Record validation: findings(seq, id, severity, rule, field, message) from items as VARIANT values.

A typed read would turn wrong types into nulls, so each field is looked at as a
variant: absent, null, or of a type that schema_of_variant names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import LIST_FIELDS, TEXT_FIELDS, json_is_list, json_items

# Fixed values.
CHECKED_LISTS = "directors writers stars genres languages countries_of_origin summaries synopsis".split()
ID = r"(?U)^tt\d{7,8}$"
URL_ID = r"(?U)/title/(tt\d{7,8})/"
RATING = r"(?U)^(?:10(?:\.0)?|\d(?:\.\d)?)$"
YEAR = r"(?U)^\d{4}$"
LINK_START = "https://www.imdb.com/"
FAILED = "Failed to extract"
PLACEHOLDERS = {
    "rating": ["Rating not found.", "Failed to extract rating."],
    "mpaa": ["MPAA rating not found.", "Failed to extract MPAA rating."],
    "release_year": ["Release year not found.", "Failed to extract release year."],
    "budget": ["Budget tag not found.", "Budget not found.", "Failed to extract budget."],
    "gross_worldwide": ["Gross worldwide tag not found.", "Gross worldwide not found.", "Failed to extract gross worldwide."],
    "languages": ["Languages not found.", "Failed to extract languages."],
    "countries_of_origin": ["No countries of origin found.", "Failed to extract countries of origin."],
    "first_page_summary": ["Summary not found.", "Failed to extract summary."],
}
ERROR, WARNING, COUNTED, MISSING = "error", "warning", "placeholder", "missing"

Finding = "array<struct<severity:string,rule:string,message:string>>"


ALL_FIELDS = [*TEXT_FIELDS, *LIST_FIELDS, "reviews"]
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def _kind(v: Column) -> Column:
    """Type name of a variant; VOID for null; null for an absent one."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _text_of(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", _as(x, "string"))


def _found(severity: str, rule: Column | str, when: Column, message: Column | str = "") -> Column:
    """A finding, or null."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(severity).alias("severity"), as_column(rule).alias("rule"), as_column(message).alias("message")))


def is_placeholder(field: Column, text: Column) -> Column:
    """Whether the field holds one of its placeholders; fields without any never do."""
    known = [f"{f}: {t}" for f, texts in PLACEHOLDERS.items() for t in texts]
    return F.concat(field, F.lit(": "), text).isin(known) | (field.isin(list(PLACEHOLDERS)) & text.startswith(FAILED))


def _null_inside(x: Column) -> Column:
    return F.is_variant_null(x) | F.coalesce(F.exists(_as(x, "array<variant>"), lambda y: F.is_variant_null(y)), F.lit(False))


def _each(rule: str, items: Column, tests: list[tuple[str, str, Callable[[Column, Column], Column]]]) -> Column:
    """Findings on the items of a list; tests: (severity, message, condition of (item, place))."""

    def of(x: Column, i: Column) -> Column:
        return F.array(*(_found(s, rule, test(x, i), F.concat(F.lit(f"{m} at "), i.cast("string"))) for s, m, test in tests))

    return F.flatten(F.transform(items, of))


def _values(items: DataFrame) -> DataFrame:
    """One row a field of each item: seq, id, field, v (its value), kind, text and list (null if it is none)."""
    name = F.expr("variant_get(item, '$.id')")
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.expr(f"variant_get(item, '$.{f}')").alias("v")) for f in ALL_FIELDS))
    out = items.select("seq", F.when(_kind(name) == "STRING", _as(name, "string")).alias("id"), F.explode(every).alias("f")).select("seq", "id", "f.*")
    out = out.withColumn("kind", _kind(F.col("v")))
    is_list = F.coalesce(F.col("kind").startswith("ARRAY"), F.lit(False))
    return out.withColumns({"text": F.when(F.col("kind") == "STRING", _as(F.col("v"), "string")), "list": F.when(is_list, _as(F.col("v"), "array<variant>")), "is_list": is_list})


def _schema() -> list[Column]:
    field, kind = F.col("field"), F.col("kind")
    gone = kind.isNull() | (kind == "VOID")
    good = (
        F.when(field.isin(TEXT_FIELDS), kind == "STRING")
        .when(field == "reviews", kind.isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>") & ~F.exists("list", _null_inside))
        # ARRAY<VOID> is an empty list, but also a list of nulls
        .otherwise(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists("list", lambda x: F.is_variant_null(x)))
    )
    return [_found(MISSING, "schema", gone, "missing"), _found(WARNING, "schema", gone, "missing"), _found(ERROR, "schema", ~gone & ~good, F.concat(F.lit("type "), kind))]


def _texts() -> list[Column]:
    field, text = F.col("field"), F.col("text")
    kinds = field.isin("release_year", "rating", "budget", "gross_worldwide")
    fits = F.when(field == "release_year", text.rlike(YEAR)).when(field == "rating", text.rlike(RATING)).otherwise(text.rlike(r"(?U)\d"))
    held = is_placeholder(field, text)
    return [
        _found(ERROR, "id", (field == "id") & (text.isNull() | ~text.rlike(ID)), _as(F.col("v"), "string")),
        _found(ERROR, field, (kinds | (field == "title")) & text.isNull(), "not a string"),
        _found(WARNING, "title", (field == "title") & text.rlike(_BLANK), "blank"),
        _found(COUNTED, field, kinds & held, text),
        _found(WARNING, field, kinds & ~held & ~fits, text),
    ]


def _lists() -> tuple[list[Column], Column]:
    field, items = F.col("field"), F.col("list")
    checked = field.isin(CHECKED_LISTS)
    first = _text_of(F.get(items, F.lit(0)))
    shown = F.transform(items, lambda x: F.to_json(x))
    one = [
        _found(ERROR, "list", checked & ~F.col("is_list"), "not a list"),
        _found(COUNTED, "list", checked & first.isNotNull() & F.exists(items, lambda x: is_placeholder(field, _text_of(x)))),
        _found(WARNING, "list", checked & (F.size(F.array_distinct(shown)) < F.size(shown)), "duplicates"),
    ]
    each = _each("list", items, [(ERROR, "not a string", lambda x, i: _text_of(x).isNull()), (WARNING, "blank", lambda x, i: _text_of(x).rlike(_BLANK))])
    return one, F.when(checked, each)


def _links() -> tuple[list[Column], Column]:
    field, kind, items = F.col("field"), F.col("kind"), F.col("list")
    texts = F.transform(items, _text_of)
    good = lambda x: F.coalesce(_text_of(x).startswith(LINK_START), F.lit(False))
    again = lambda x, i: good(x) & (F.array_position(texts, _text_of(x)) - 1 < i)
    tests = [(WARNING, "bad URL", lambda x, i: ~good(x)), (WARNING, "bad id", lambda x, i: good(x) & (F.regexp_extract(_text_of(x), URL_ID, 1) == "")), (WARNING, "duplicate link", again)]
    links = field == "related_links"
    # an absent field is an empty list, an explicit null is not a list
    return [_found(ERROR, "links", links & kind.isNotNull() & ~F.col("is_list"), "not a list")], F.when(links, _each("links", items, tests))


def _reviews() -> tuple[list[Column], Column]:
    # of each review: whether it is a list, its size, its text and its score
    parts = lambda x: _as(x, "array<variant>")
    seen = F.transform("list", lambda x: F.struct(F.schema_of_variant(x).startswith("ARRAY").alias("listed"), parts(x).alias("parts")))
    size = lambda x: F.coalesce(F.size(x["parts"]), F.lit(0))
    seen = F.transform(seen, lambda x: F.struct(
        x["listed"].alias("listed"), size(x).alias("size"),
        F.when(size(x) > 0, _text_of(F.get(x["parts"], F.lit(0)))).otherwise("").alias("text"),
        F.when(size(x) > 1, _text_of(F.get(x["parts"], F.lit(1)))).otherwise("N/A").alias("score"),
    ))
    tests = [
        (ERROR, "not a list", lambda x, i: ~x["listed"]),
        (WARNING, "short", lambda x, i: x["listed"] & (x["size"] < 2)),
        (WARNING, "no text", lambda x, i: x["listed"] & (x["text"].isNull() | x["text"].rlike(_BLANK))),
        (WARNING, "score not a string", lambda x, i: x["listed"] & x["score"].isNull()),
        (WARNING, "odd score", lambda x, i: x["listed"] & (x["score"] != "N/A") & ~x["score"].rlike(r"(?U)^\d{1,2}$")),
        (WARNING, "score out of range", lambda x, i: x["listed"] & x["score"].rlike("^[0-9]{1,2}$") & (x["score"].try_cast("int") > 10)),
    ]
    mine = F.col("field") == "reviews"
    return [_found(ERROR, "reviews", mine & ~F.col("is_list"), "not a list")], F.when(mine, _each("reviews", seen, tests))


def findings(items: DataFrame) -> DataFrame:
    """Findings on items(seq, item variant), duplicate ids included (with the id's first seq).

    Each field is a row of its own, so that a rule stands once in the plan for all
    fields that it is for.
    """
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    parts = [_lists(), _links(), _reviews()]
    one = [*_schema(), *_texts(), *(c for some, _ in parts for c in some)]
    each = [F.coalesce(c, F.array().cast(Finding)) for _, c in parts]
    objects = _values(items.where(is_object)).select("seq", "id", "field", F.explode(F.array_compact(F.concat(F.array(*one), *each))).alias("f"))
    others = items.where(~is_object).select("seq", F.lit(None).cast("string").alias("id"), F.lit(ERROR).alias("severity"), F.lit("object").alias("rule"), F.lit("").alias("field"), F.lit("not an object").alias("message"))
    rows = objects.select("seq", "id", "f.severity", "f.rule", "field", "f.message").unionByName(others)
    return rows.unionByName(
        duplicate_ids(items).select("seq", "id", F.lit(ERROR).alias("severity"), F.lit("unique").alias("rule"), F.lit("id").alias("field"), F.concat(F.col("n").cast("string"), F.lit(" records")).alias("message"))
    )


def duplicate_ids(items: DataFrame) -> DataFrame:
    ids = items.where(F.schema_of_variant("item").startswith("OBJECT")).select("seq", F.expr("variant_get(item, '$.id')").alias("v"))
    ids = ids.select("seq", F.when(_kind(F.col("v")) == "STRING", _as(F.col("v"), "string")).alias("id"))
    return ids.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")


def by_field(found: DataFrame, severity: str = MISSING) -> DataFrame:
    return found.where(F.col("severity") == severity).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def summary(found: DataFrame, shown: int = 10) -> tuple[int, int, list[str], list[str]]:
    """(errors, warnings, the first of each). All duplicate ids together are one error."""
    counts = {r[0]: r[1] for r in found.groupBy(F.when(F.col("rule") == "unique", "unique").otherwise(F.col("severity")).alias("s")).count().collect()}
    first = lambda s: [f"{r['id']}: {r['field']} {r['message']}" for r in found.where(F.col("severity") == s).orderBy("seq", "field", "rule", "message").limit(shown).collect()]
    return counts.get(ERROR, 0) + (counts.get("unique", 0) > 0), counts.get(WARNING, 0), first(ERROR), first(WARNING)


def placeholders(found: DataFrame) -> DataFrame:
    return by_field(found, COUNTED)


def report(found: DataFrame, total: int, too_few: str = "") -> tuple[int, int, list[str]]:
    """(errors, warnings, lines of the report). The fields are eighteen; of errors and warnings the first ten are shown."""
    errors, warnings, first_errors, first_warnings = summary(found)
    if too_few:
        errors, first_errors = errors + 1, [too_few, *first_errors][:10]
    out = [f"Records: {total}", f"Errors: {errors} | Warnings: {warnings}"]
    for title, counts in (("Missing fields", by_field(found)), ("Placeholders", placeholders(found))):
        rows = counts.collect()
        out += [f"{title}:", *(f"  - {r['field']}: {r['n']}" for r in rows)] if rows else []
    out += ["First errors:", *(f"  * {x}" for x in first_errors)] if first_errors else []
    out += ["First warnings:", *(f"  - {x}" for x in first_warnings)] if first_warnings else []
    return errors, warnings, out


def validate(spark: SparkSession, path: str, min_count: int = 5, fail_on_warning: bool = False, say: Callable[[str], None] = print) -> int:
    """0 passed, 1 errors, 2 warnings where they count as failures; the report is printed."""
    if not json_is_list(spark, path):
        say("Records: 0\nErrors: 1 | Warnings: 0\nFirst errors:\n  * the top level is not a list\nFAILED")
        return 1
    items = json_items(spark, path)
    total = items.count()
    found = findings(items).persist()  # read for each part of the report
    errors, warnings, lines = report(found, total, f"{total} records, {min_count} expected" if total < min_count else "")
    found.unpersist()
    code = 1 if errors else 2 if fail_on_warning and warnings else 0
    say("\n".join([*lines, ("PASSED", "FAILED", "FAILED (warnings count)")[code]]))
    return code
