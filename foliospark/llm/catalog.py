"""The operators' queries and their SQL."""

from __future__ import annotations

from foliospark.llm import chat, langid, mixing, packing, pii, quality, secrets, simhash, tokencount, topk

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_chat": chat.op2_chat,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_topk": topk.op7_topk,
    "op8_mixing": mixing.op8_mixing,
    "op9_langid": langid.op9_langid,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op2_chat": chat.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op7_topk": topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
