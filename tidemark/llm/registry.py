"""Queries of the numbered operators, by name, and their SQL."""

from __future__ import annotations

from tidemark.llm import collocations, conversation_repair, decontamination, embedding_dedup, hidden_markov, line_dedup, ngram_join, packing, pii, quality, token_counts, url_filters, warc

QUERIES = {
    "op1_positional_decontamination": decontamination.op1_positional_decontamination,
    "op2_warc_normaliser": warc.op2_warc_normaliser,
    "op3_quality_ftrl": quality.op3_quality_ftrl,
    "op4_multi_order_jaccard": ngram_join.op4_multi_order_jaccard,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_hyperplane_near_dedup": embedding_dedup.op6_hyperplane_near_dedup,
    "op7_semi_markov_pii": pii.op7_semi_markov_pii,
    "op8_power_of_two_packing": packing.op8_power_of_two_packing,
    "op9_segment_edit_line_dedup": line_dedup.op9_segment_edit_line_dedup,
    "op10_association_url_filter": url_filters.op10_association_url_filter,
    "op11_hidden_markov_scores": hidden_markov.op11_hidden_markov_scores,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_setm_collocations": collocations.op13_setm_collocations,
}
ORACLES = {
    "op1_positional_decontamination": decontamination.OP1_SQL,
    "op2_warc_normaliser": warc.OP2_SQL,
    "op4_multi_order_jaccard": ngram_join.OP4_SQL,
    "op9_segment_edit_line_dedup": line_dedup.OP9_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_setm_collocations": collocations.OP13_SQL,
}
