"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, fingerprints, hnsw, jaccard_join, lm_scoring, merkle, mixing, packing, pieces, pii, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_pii": pii.op3_pii,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_embedding_dedup": hnsw.op10_embedding_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_pieces": pieces.op12_pieces,
    "op13_alignment": alignment.op13_alignment,
}

SQL: dict[str, str] = {
    "op1_lm_scoring": lm_scoring.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_embedding_dedup": hnsw.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
