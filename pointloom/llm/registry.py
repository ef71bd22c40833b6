"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pointloom.llm import chat, decontam, jaccard, licences, media, packing, quality, sharding, suffixes, urls

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_packing": packing.op2_packing,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_url_filter": urls.op8_url_filter,
    "op9_media": media.op9_media,
    "op10_jaccard": jaccard.op10_jaccard,
}

ORACLES = {
    "op6_chat_format": chat.OP6_SQL,
    "op7_decontaminate": decontam.OP7_SQL,
}
