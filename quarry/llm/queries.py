"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .decontaminate import op10_benchmark_decontamination
from .jaccard import op6_ngram_jaccard_join
from .language import op5_language_id
from .packing import op8_best_fit_packing
from .pages import op9_html_extraction
from .paragraphs import op7_substring_dedup
from .pii import op1_pii, pii_base
from .quality import op4_quality_rules
from .secrets import op2_secret_scans
from .substrings import op3_suffix_array_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [op1_pii, op2_secret_scans, op3_suffix_array_dedup, op4_quality_rules, op5_language_id, op6_ngram_jaccard_join, op7_substring_dedup, op8_best_fit_packing, op9_html_extraction, op10_benchmark_decontamination, pii_base]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
