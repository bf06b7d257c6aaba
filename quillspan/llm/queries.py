"""The operators of this subpackage over the whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, html_extraction, language_id, license_scan, near_dup, personal_data, quality_rules, source_divergence, source_mix, token_alignment, tool_calls, warc
from .common import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_tool_calls": tool_calls.op1,
    "op2_fingerprints": _shipped(fingerprints.op2),
    "op3_html_extraction": _shipped(html_extraction.op3),
    "op4_license_scan": license_scan.op4,
    "op5_source_mix": source_mix.op5,
    "op6_language_id": _shipped(language_id.op6),
    "op7_quality_rules": quality_rules.op7,
    "op8_warc": _shipped(warc.op8),
    "op9_byte_bpe": _shipped(byte_bpe.op9),
    "op10_near_dup": _shipped(near_dup.op10),
    "op11_source_divergence": _shipped(source_divergence.op11),
    "op12_personal_data": _shipped(personal_data.op12),
    "op13_token_alignment": _shipped(token_alignment.op13),
}

ORACLE = {
    "op1_tool_calls": tool_calls.ORACLE_SQL,
    "op4_license_scan": license_scan.ORACLE_SQL,
    "op5_source_mix": source_mix.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op11_source_divergence": source_divergence.ORACLE_SQL,
}
