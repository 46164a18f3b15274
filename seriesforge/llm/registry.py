"""Registered queries of this subpackage; SQL twins where SQL can state them over whole tables."""

from __future__ import annotations

from seriesforge.llm import (
    op01_quality,
    op02_tokens,
    op03_suffix,
    op04_pq,
    op05_pieces,
    op06_images,
    op07_pitman_yor,
    op08_packing,
    op09_toxicity,
    op10_minhash,
    sql,
)


def queries() -> dict:
    return {
        "op1_quality": op01_quality.query,
        "op2_tokens": op02_tokens.query,
        "op3_suffix": op03_suffix.query,
        "op4_pq": op04_pq.query,
        "op5_pieces": op05_pieces.query,
        "op6_images": op06_images.query,
        "op7_pitman_yor": op07_pitman_yor.query,
        "op8_packing": op08_packing.query,
        "op9_toxicity": op09_toxicity.query,
        "op10_minhash": op10_minhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
