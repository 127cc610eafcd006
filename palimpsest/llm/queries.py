"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, frames, katz, langid, lines, minhash, multiindex, neighbours, packing, pieces, sketches, suffixes

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_array_dedup": suffixes.op2_suffix_array_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_lm_scoring": katz.op5_lm_scoring,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_embedding_near_dedup": neighbours.op9_embedding_near_dedup,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
    "op11_nearest_neighbours": multiindex.op11_nearest_neighbours,
    "op12_fill_in_middle": frames.op12_fill_in_middle,
    "op13_ranked_search": sketches.op13_ranked_search,
}
SQL: dict[str, str] = {"op3_chat_formatting": chat.OP3_SQL, "op12_fill_in_middle": frames.OP12_SQL, "op13_ranked_search": sketches.OP13_SQL}
