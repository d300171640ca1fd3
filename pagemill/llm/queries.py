"""Queries over the driver's tables for the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from . import embedding_dedup, html_text, line_dedup, minhash_dedup, mixing, oracle, packing, quality, secrets, sharding, token_counts


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1,
        "op2_subspace_pigeonhole": embedding_dedup.op2,
        "op3_prob_minhash": minhash_dedup.op3,
        "op4_feistel_sharding": sharding.op4,
        "op5_subset_sum_mix": mixing.op5,
        "op6_best_fit_packing": packing.op6,
        "op7_viterbi_token_counts": token_counts.op7,
        "op8_line_templates": line_dedup.op8,
        "op9_block_lstm_text": html_text.op9,
        "op10_secret_scan": secrets.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracle.quality(),
        "op2_subspace_pigeonhole": oracle.embeddings(),
        "op4_feistel_sharding": oracle.sharding(),
    }
