"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, jaccard, language, licenses, lines, lm, packing, shards, substrings, tokenids, turns


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprint.op1_fingerprints,
        "op2_language": language.op2_language,
        "op3_token_ids": tokenids.op3_token_ids,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_ppm": lm.op5_ppm,
        "op6_substrings": substrings.op6_substrings,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_packing": packing.op9_packing,
        "op10_licenses": licenses.op10_licenses,
        "op11_turns": turns.op11_turns,
        "op12_shards": shards.op12_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.SQL,
        "op6_substrings": substrings.SQL,
        "op7_jaccard": jaccard.SQL,
        "op11_turns": turns.SQL,
    }
