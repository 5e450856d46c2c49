"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from driftline.llm import crf, language_id, lengths, line_dedup, link_graph, matroska, near_dups, packing, pieces, quality

QUERIES = {
    "op1_quality_divergence": quality.query,
    "op2_length_histogram": lengths.query,
    "op3_sentencepiece_viterbi": pieces.query,
    "op4_pii_crf": crf.query,
    "op5_line_dedup": line_dedup.query,
    "op6_url_link_graph": link_graph.query,
    "op7_ngram_jaccard_join": near_dups.query,
    "op8_matroska_packets": matroska.query,
    "op9_language_bitmask": language_id.query,
    "op10_vector_packing": packing.query,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_url_link_graph": link_graph.ORACLE,
}
