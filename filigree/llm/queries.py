"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this package that holds query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL
NAMES = {
    "op9_vantage_point_search": "vptree_ann",
    "op8_hmm_language_model": "hmm_lm",
    "op10_token_output": "token_output",
    "op6_minhash_near_dedup": "minhash_dedup",
    "op1_toxicity_grammar": "toxicity",
    "op5_template_decontamination": "decontaminate",
    "op2_pfair_mixing": "mixing",
    "op7_license_digests": "license_scan",
    "op3_main_text": "html_extract",
    "op4_substring_dedup": "substring_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
