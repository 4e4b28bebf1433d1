"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from loamwork.llm.ann import op6_cross_polytope
from loamwork.llm.backtrack_bpe import op12_backtracking_bpe
from loamwork.llm.byte_bpe import op5_byte_bpe
from loamwork.llm.class_lm import op9_class_lm
from loamwork.llm.merkle import OP11_SQL, op11_merkle_manifest
from loamwork.llm.mixing import OP10_SQL, op10_weighted_fair_mix
from loamwork.llm.near_dup import OP1_SQL, op1_ngram_jaccard
from loamwork.llm.order_minhash import op2_order_minhash
from loamwork.llm.sharding import OP8_SQL, op8_extendible_shards
from loamwork.llm.quality import op4_quality
from loamwork.llm.toxicity import op7_toxicity
from loamwork.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from loamwork.llm.vector_codes import OP13_SQL, op13_vector_codes

ALL = (op1_ngram_jaccard, op2_order_minhash, op3_substring_dedup, op4_quality, op5_byte_bpe, op6_cross_polytope, op7_toxicity, op8_extendible_shards, op9_class_lm, op10_weighted_fair_mix, op11_merkle_manifest, op12_backtracking_bpe, op13_vector_codes)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op8_extendible_shards": OP8_SQL, "op10_weighted_fair_mix": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_vector_codes": OP13_SQL}
