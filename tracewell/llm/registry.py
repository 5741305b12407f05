"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontamination, importance, licenses, near_duplicates, packing, pii, preferences, quality, secrets, simhash, token_counts, token_files, vector_codes


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_licenses": licenses.op2_licenses,
        "op3_near_duplicates": near_duplicates.op3_near_duplicates,
        "op4_pii": pii.op4_pii,
        "op5_preferences": preferences.op5_preferences,
        "op6_packing": packing.op6_packing,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_importance": importance.op12_importance,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": near_duplicates.oracle(),
        "op5_preferences": preferences.oracle(),
        "op7_secret_scan": secrets.oracle(),
        "op9_quality_rules": quality.oracle(),
        "op10_decontamination": decontamination.oracle(),
        "op11_vector_codes": vector_codes.oracle(),
        "op12_importance": importance.oracle(),
    }
