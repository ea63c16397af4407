"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from gradewise.llm import (
    ann,
    byte_bpe,
    collocations,
    conversations,
    decontaminate,
    licenses,
    packing,
    quality,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality": quality.op5_quality,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_packing": packing.op10_token_packing,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
