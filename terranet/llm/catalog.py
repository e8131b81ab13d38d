"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from terranet.llm import decontaminate, heap_means, line_crf, line_index, mixture, near, negatives, pieces, site_tree, sketches, token_file, toxicity, warc

QUERIES = {
    "op1_fingerprints": sketches.op1_fingerprints,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_token_files": token_file.op3_token_files,
    "op4_ngram_jaccard_join": near.op4_ngram_jaccard_join,
    "op5_warc": warc.op5_warc,
    "op6_token_counts": pieces.op6_token_counts,
    "op7_mix_sources": mixture.op7_mix_sources,
    "op8_html_extraction": site_tree.op8_html_extraction,
    "op9_quality_classifier": line_crf.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_centroid_clustering": heap_means.op12_centroid_clustering,
    "op13_line_dedup": line_index.op13_line_dedup,
}
ORACLES = {
    "op4_ngram_jaccard_join": near.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_mix_sources": mixture.OP7_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_centroid_clustering": heap_means.OP12_SQL,
    "op13_line_dedup": line_index.OP13_SQL,
}
