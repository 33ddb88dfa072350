"""Places of pattern matches as Spark columns: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between the matches gives their places; a pattern that can match
    the empty string is not allowed.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.array().cast("array<struct<m:string,start:int,end:int>>").alias("a"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(F.concat(acc["a"], F.array(F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end")))).alias("a"), end.alias("at"))

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), zero, step)["a"]
