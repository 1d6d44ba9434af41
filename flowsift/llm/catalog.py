"""Queries of this subpackage and their SQL checks."""

from __future__ import annotations

from flowsift.llm import align, contextmix, graphs, links, mixing, neardup, packing, personal, perspectives, pivots, tokenfiles, toxicity, trie

QUERIES = {
    "op1_source_mix": mixing.op1,
    "op2_pivot_top_k": pivots.op2,
    "op3_token_files": tokenfiles.op3,
    "op4_context_mixing": contextmix.op4,
    "op5_near_duplicates": neardup.op5,
    "op6_tier_packing": packing.op6,
    "op7_graph_neighbours": graphs.op7,
    "op8_perspectives": perspectives.op8,
    "op9_toxicity": toxicity.op9,
    "op10_link_trust": links.op10,
    "op11_token_alignment": align.op11,
    "op12_prefix_trie": trie.op12,
    "op13_personal_data": personal.op13,
}

ORACLES = {
    "op2_pivot_top_k": pivots.OP2_SQL,
    "op5_near_duplicates": neardup.op5_sql(),
    "op8_perspectives": perspectives.OP8_SQL,
    "op10_link_trust": links.op10_sql(),
    "op12_prefix_trie": trie.OP12_SQL,
}
