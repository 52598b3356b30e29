"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import ann, chat, conversation_repair, embedding_dedup, html, lexical_search, mixing, ngram_join, packing, quality_mil, quality_rules, secrets, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_chat_format": chat.op5_chat_format,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_mil": quality_mil.op9_quality_mil,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}
ORACLES = {
    "op5_chat_format": chat.OP5_SQL,
    "op7_ngram_jaccard": ngram_join.OP7_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_embedding_dedup": embedding_dedup.OP13_SQL,
}
