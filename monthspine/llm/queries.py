"""The registered queries of this folder: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op12_alignment
from .common import table
from .decontaminate import op2_decontamination
from .html_text import op1_main_text
from .language import op9_language
from .mixing import OP7_SQL, op7_mixing
from .packing import op11_packing
from .quality import op3_quality
from .rules import OP10_SQL, op10_rules
from .simhash import simhash_components
from .substrings import OP5_SQL, op5_substrings
from .tokens import op4_tokens
from .toxicity import op6_toxicity
from .variants import op13_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": lambda spark, d: op1_main_text(table(spark, d, "pages")),
    "op2_decontamination": lambda spark, d: op2_decontamination(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_quality_classifier": lambda spark, d: op3_quality(table(spark, d, "documents")),
    "op4_token_binary": lambda spark, d: op4_tokens(spark, table(spark, d, "documents")),
    "op5_substring_dedup": lambda spark, d: op5_substrings(table(spark, d, "documents")),
    "op6_toxicity": lambda spark, d: op6_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_source_mixing": lambda spark, d: op7_mixing(spark, table(spark, d, "documents")),
    "op8_simhash_dedup": lambda spark, d: simhash_components(spark, table(spark, d, "documents")),
    "op9_language_id": lambda spark, d: op9_language(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: op10_rules(table(spark, d, "documents")),
    "op11_packing": lambda spark, d: op11_packing(spark, table(spark, d, "documents")),
    "op12_tokenizer_alignment": lambda spark, d: op12_alignment(spark, table(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: op13_variants(spark, table(spark, d, "documents")),
}

SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op7_source_mixing": OP7_SQL, "op10_quality_rules": OP10_SQL}
