"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grapheion.llm import binary_ids, byte_bpe, html_text, kneser_ney, near_dup, overwrite, packing, phrases, pii, quality, quotes, sketch, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quote_linking": quotes.op1_quote_linking,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_quality": quality.op3_quality,
        "op4_kneser_ney": kneser_ney.op4_kneser_ney,
        "op5_packing": packing.op5_packing,
        "op6_html_text": html_text.op6_html_text,
        "op7_binary_ids": binary_ids.op7_binary_ids,
        "op8_sketch": sketch.op8_sketch,
        "op9_near_dup": near_dup.op9_near_dup,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_pii": pii.op11_pii,
        "op12_phrases": phrases.op12_phrases,
        "op13_late_overwrite": overwrite.op13_late_overwrite,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_near_dup": near_dup.ORACLE_SQL}
