"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from fathom.llm import bpe, conversations, embedding_dedup, fim, licenses, mixing, near_dedup, pii, quality, sharding, substring, token_files, topk

QUERIES = {
    "op1_pfair_mixing": mixing.op1,
    "op2_topk_bitslices": topk.op2,
    "op3_bpe_trie": bpe.op3,
    "op4_token_files": token_files.op4,
    "op5_cotrained_quality": quality.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_embedding_dedup": embedding_dedup.op7,
    "op8_pii_weak_supervision": pii.op8,
    "op9_repeated_passages": substring.op9,
    "op10_license_scan": licenses.op10,
    "op11_histogram_sort": sharding.op11,
    "op12_conversation_repair": conversations.op12,
    "op13_fill_in_middle": fim.op13,
}

ORACLES: dict[str, str] = {
    "op1_pfair_mixing": mixing.SQL,
    "op2_topk_bitslices": topk.SQL,
    "op10_license_scan": licenses.SQL,
    "op11_histogram_sort": sharding.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_fill_in_middle": fim.SQL,
}
