"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, language, lm, near_dedup, packing, pii, quality, secrets, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_secrets": secrets.op2_secrets,
        "op3_quality": quality.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_pii": pii.op6_pii,
        "op9_language": language.op9_language,
        "op10_topk": topk.op10_topk,
        "op7_lm": lm.op7_lm,
        "op8_decontamination": decontamination.op8_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.ORACLE, "op10_topk": topk.ORACLE}
