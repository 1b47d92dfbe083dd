"""The queries of this subpackage by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from lexloom.llm import crf, decontaminate, digest_index, hilbert, mixing_coder, packing, passages, simhash, suffix_tree, toxicity

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op2_simhash_ball": simhash.op2_simhash_ball,
    "op3_chained_passages": passages.op3_chained_passages,
    "op4_digest_index": digest_index.op4_digest_index,
    "op5_deobfuscated_toxicity": toxicity.op5_deobfuscated_toxicity,
    "op6_hilbert_shards": hilbert.op6_hilbert_shards,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_mixing_coder": mixing_coder.op8_mixing_coder,
    "op9_crf_language": crf.op9_crf_language,
    "op10_spaced_seeds": decontaminate.op10_spaced_seeds,
}

ORACLES = {"op4_digest_index": digest_index.OP4_SQL}
