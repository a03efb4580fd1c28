"""The queries of this package, as the driver contract file lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm.collocations import PHRASE_SQL, op12_phrase_collocations
from textquarry.llm.contexts import op5_contextual_personal_data
from textquarry.llm.conversations import REPAIR_SQL, op11_conversation_repair
from textquarry.llm.fingerprints import op9_scaled_fingerprints
from textquarry.llm.language_model import op4_hidden_markov_scores
from textquarry.llm.mixing import MIX_SQL, op3_fair_queue_mixing
from textquarry.llm.near_dups import NEAR_SQL, op7_minhash_near_duplicates
from textquarry.llm.packing import op2_pattern_packing
from textquarry.llm.quality_classifier import op6_ordinal_quality
from textquarry.llm.quality_rules import op8_learned_quality_rules
from textquarry.llm.repeats import REPEAT_SQL, op13_repeated_passages
from textquarry.llm.secrets import op10_linked_secrets
from textquarry.llm.token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_pattern_packing": op2_pattern_packing,
    "op3_fair_queue_mixing": op3_fair_queue_mixing,
    "op4_hidden_markov_scores": op4_hidden_markov_scores,
    "op5_contextual_personal_data": op5_contextual_personal_data,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_minhash_near_duplicates": op7_minhash_near_duplicates,
    "op8_learned_quality_rules": op8_learned_quality_rules,
    "op9_scaled_fingerprints": op9_scaled_fingerprints,
    "op10_linked_secrets": op10_linked_secrets,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_repeated_passages": op13_repeated_passages,
}

ORACLE_SQL: dict[str, str] = {
    "op3_fair_queue_mixing": MIX_SQL,
    "op7_minhash_near_duplicates": NEAR_SQL,
    "op11_conversation_repair": REPAIR_SQL,
    "op12_phrase_collocations": PHRASE_SQL,
    "op13_repeated_passages": REPEAT_SQL,
}
