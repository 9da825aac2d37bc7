"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from gleaner.llm import fingerprint, jaccard_join, language_id, license_scan, line_dedup, nearest, packing, pieces, secret_scan, substring_dedup


def queries():
    return {
        "op1_license_scan": license_scan.query,
        "op2_language_id": language_id.query,
        "op3_pieces": pieces.query,
        "op4_secret_scan": secret_scan.query,
        "op5_packing": packing.query,
        "op6_fingerprint": fingerprint.query,
        "op7_line_dedup": line_dedup.query,
        "op8_nearest": nearest.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_substring_dedup": substring_dedup.query,
    }


def oracle_sql():
    return {"op1_license_scan": license_scan.SQL, "op7_line_dedup": line_dedup.SQL, "op9_jaccard_join": jaccard_join.SQL, "op10_substring_dedup": substring_dedup.SQL}
