"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, fingerprint, html, lm, media, merkle, mixing, multiindex, neardup, packing, pii, quality, sharding

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_main_text": html.op2_main_text,
    "op3_quality_resampling": quality.op3_quality_resampling,
    "op4_image_copies": media.op4_image_copies,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_log_bilinear_scores": lm.op6_log_bilinear_scores,
    "op7_balanced_shards": sharding.op7_balanced_shards,
    "op8_pii_sanitisation": pii.op8_pii_sanitisation,
    "op9_weighted_fingerprints": fingerprint.op9_weighted_fingerprints,
    "op10_minhash_near_dedup": neardup.op10_minhash_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_filter_interaction": audit.op12_filter_interaction,
    "op13_multi_index_search": multiindex.op13_multi_index_search,
}
ORACLE_SQL = {
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_filter_interaction": audit.ORACLE_SQL,
    "op13_multi_index_search": multiindex.ORACLE_SQL,
}
