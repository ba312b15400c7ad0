"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from cohorta.llm import collocations, conversations, oracles, topk
from cohorta.llm.decontaminate import op1_decontaminate
from cohorta.llm.language import op10_language_id
from cohorta.llm.near_dedup import op4_near_dedup
from cohorta.llm.packing import op5_packing
from cohorta.llm.quality import op12_quality_rules
from cohorta.llm.secrets import op6_secrets
from cohorta.llm.shards import op9_training_order
from cohorta.llm.substring_dedup import op3_substring_dedup
from cohorta.llm.toxicity import op2_toxicity
from cohorta.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_url_filter": op7_url_filter,
    "op8_top_k": topk.op8_top_k,
    "op9_training_order": op9_training_order,
    "op10_language_id": op10_language_id,
    "op11_collocations": collocations.op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op3_substring_dedup": oracles.SUBSTRINGS,
    "op4_near_dedup": oracles.NEAR_DUPLICATES,
    "op8_top_k": topk.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
