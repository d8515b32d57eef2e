"""The queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from . import bpe, license_scan, lm_score, media, near_dup, packing, quality_lm, quality_rules, suffix_dedup, url_filter

QUERIES = {
    "op1_near_dedup": near_dup.op1_near_dedup,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_packing": packing.op3_packing,
    "op4_media_columns": media.op4_media_columns,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_quality_lm": quality_lm.op7_quality_lm,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_license_scan": license_scan.op10_license_scan,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dup.oracle(),
        "op5_url_filter": url_filter.oracle(),
        "op6_quality_rules": quality_rules.oracle(),
        "op10_license_scan": license_scan.oracle(),
    }
