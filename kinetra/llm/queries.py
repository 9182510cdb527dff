"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from kinetra.llm import avi, chat, divergence, exactdedup, jaccard, linededup, merkle, mixing, packing, quality, tokencount, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_avi": avi.op3_avi,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat": chat.op5_chat,
    "op6_mix": mixing.op6_mix,
    "op7_pack": packing.op7_pack,
    "op8_exact_dedup": exactdedup.op8_exact_dedup,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_divergence": divergence.op11_divergence,
    "op12_tokens": tokencount.op12_tokens,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {
    "op2_jaccard": jaccard.OP2_SQL,
    "op5_chat": chat.OP5_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op8_exact_dedup": exactdedup.OP8_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
