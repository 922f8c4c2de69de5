"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from plumage.llm import ann, bpe, clustering, embed_dedup, html, line_dedup, lm, minhash, oracles, packing, quality, secret_scan, toxicity, whitening


def queries() -> dict:
    return {
        "op1_conv_toxicity": toxicity.op1,
        "op2_segment_line_dedup": line_dedup.op2,
        "op3_bitmap_bpe": bpe.op3,
        "op4_minmax_near_dedup": minhash.op4,
        "op5_block_nearest": ann.op5,
        "op6_least_squares_packing": packing.op6,
        "op7_weak_label_quality": quality.op7,
        "op8_bloom_lm": lm.op8,
        "op9_hyperplane_dedup": embed_dedup.op9,
        "op10_template_html": html.op10,
        "op11_secret_ownership": secret_scan.op11,
        "op12_partial_distance_clusters": clustering.op12,
        "op13_lanczos_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
