"""The queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from . import crf, itq, mixing, packing, quality_rules, rollups, sharding, simhash, toxicity, url_rules

QUERIES = {
    "op1_crf_quality": crf.op1_crf_quality,
    "op2_itq_near_dup": itq.op2_itq_near_dup,
    "op3_pow2_packing": packing.op3_pow2_packing,
    "op4_ngram_llr": quality_rules.op4_ngram_llr,
    "op5_entropy_mix": mixing.op5_entropy_mix,
    "op6_ring_shards": sharding.op6_ring_shards,
    "op7_lexicon_toxicity": toxicity.op7_lexicon_toxicity,
    "op8_anchor_simhash": simhash.op8_anchor_simhash,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_token_rollups": rollups.op10_token_rollups,
}

ORACLE_SQL: dict[str, str] = {
    "op2_itq_near_dup": itq.OP2_SQL,
    "op5_entropy_mix": mixing.OP5_SQL,
    "op9_url_rules": url_rules.OP9_SQL,
}
