"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from rulelens.llm import alignment, conversations, embedding_dedup, language_id, license_scan, minhash_dedup, mixing, packing, quality, sharding, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": language_id.op2_language_id,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_packing": packing.op5_packing,
    "op6_topk": topk.op6_topk,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_quality": quality.op10_quality,
    "op11_sharding": sharding.op11_sharding,
    "op12_alignment": alignment.op12_alignment,
    "op13_conversations": conversations.op13_conversations,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op6_topk": topk.OP6_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op13_conversations": conversations.OP13_SQL,
}
