"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import filter_audit, merkle, url_rules
from panelforge.llm.bpe import op6_bpe
from panelforge.llm.decontaminate import op9_decontaminate
from panelforge.llm.fingerprint import op2_fingerprint
from panelforge.llm.language import op5_language
from panelforge.llm.minhash import op13_minhash
from panelforge.llm.ngram_join import op4_ngram_join
from panelforge.llm.quality import op10_quality
from panelforge.llm.secrets import op7_secrets
from panelforge.llm.suffix_dedup import op8_suffix_dedup
from panelforge.llm.toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprint": op2_fingerprint,
        "op3_url_rules": url_rules.op3_url_rules,
        "op4_ngram_join": op4_ngram_join,
        "op5_language": op5_language,
        "op6_bpe": op6_bpe,
        "op7_secrets": op7_secrets,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_rules": url_rules.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
    }
