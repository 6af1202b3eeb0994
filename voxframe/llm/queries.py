"""The queries of this subpackage, by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import centroids, chat_format, exact_dedup, media_ogg, mixing, packing, periodic_runs, quality, simhash, suffix_dedup, token_counts, warc_fixity, window_dedup

QUERIES = {
    "op1_warc_fixity": warc_fixity.op1,
    "op2_quality_classifier": quality.op2,
    "op3_token_counts": token_counts.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_window_dedup": window_dedup.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_source_mixing": mixing.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_ogg_media": media_ogg.op10,
    "op11_centroid_clusters": centroids.op11,
    "op12_chat_format": chat_format.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

ORACLE_SQL = {
    "op1_warc_fixity": warc_fixity.OP1_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_window_dedup": window_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op11_centroid_clusters": centroids.OP11_SQL,
    "op12_chat_format": chat_format.OP12_SQL,
}
