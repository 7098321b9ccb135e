"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from sparkloom.llm import bpe, decontaminate, language_model, licenses, neighbours, pii, quality, sharding, simhash, token_counts

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash": simhash.op7_simhash,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_language_model": language_model.op9_language_model,
    "op10_sharding": sharding.op10_sharding,
}

#: The others can't be written in SQL, or only by far too slow SQL; tests hold them against brute force.
ORACLES = {"op4_decontamination": decontaminate.ORACLE, "op8_neighbours": neighbours.ORACLE}
