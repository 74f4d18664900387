"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import chat_format, license_scan, source_audit
from ledgerloom.llm.chat_format import op13_chat_format
from ledgerloom.llm.decontaminate import op9_decontaminate
from ledgerloom.llm.license_scan import op6_license_scan
from ledgerloom.llm.lm_score import op7_lm_score
from ledgerloom.llm.pieces import op3_sentencepiece
from ledgerloom.llm.prefix_trie import op11_prefix_trie
from ledgerloom.llm.quality_classifier import op1_quality_classifier
from ledgerloom.llm.quality_rules import op10_quality_rules
from ledgerloom.llm.secret_scan import op2_secret_scan
from ledgerloom.llm.simhash import op8_simhash
from ledgerloom.llm.source_audit import op12_source_audit
from ledgerloom.llm.substring_dedup import op4_suffix_dedup
from ledgerloom.llm.token_orc import op5_token_orc
from ledgerloom.session import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality_classifier, op2_secret_scan, op3_sentencepiece, op4_suffix_dedup, op5_token_orc, op6_license_scan, op7_lm_score, op8_simhash, op9_decontaminate, op10_quality_rules, op11_prefix_trie, op12_source_audit, op13_chat_format]
    return {q.__name__: _shipped(q) for q in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_scan.oracle_sql(), "op12_source_audit": source_audit.ORACLE_SQL, "op13_chat_format": chat_format.ORACLE_SQL}
