"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard_join, language, licenses, line_dedup, mixing, nearest, quality, secrets, suffix_dedup


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_language_id": language.op2_language_id,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_nearest": nearest.op9_nearest,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.ORACLE}
