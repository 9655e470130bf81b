"""The queries of this package by name, and SQL for those that SQL can express."""

from revmill.llm import chat, prefixes
from revmill.llm.alignment import op13_cross_tokenizer_alignment
from revmill.llm.decontaminate import op10_benchmark_decontamination
from revmill.llm.extraction import op12_html_extraction
from revmill.llm.interpolation import op1_language_model
from revmill.llm.lengths import op9_token_counts
from revmill.llm.neighbours import op2_nearest_neighbours
from revmill.llm.packing import op8_best_fit_packing
from revmill.llm.quality import op3_quality
from revmill.llm.repeats import op6_suffix_dedup
from revmill.llm.simhash import op5_simhash
from revmill.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_model,
        op2_nearest_neighbours,
        op3_quality,
        chat.op4_chat_formatting,
        op5_simhash,
        op6_suffix_dedup,
        op7_toxicity,
        op8_best_fit_packing,
        op9_token_counts,
        op10_benchmark_decontamination,
        prefixes.op11_conversation_prefix_trie,
        op12_html_extraction,
        op13_cross_tokenizer_alignment,
    )
}

ORACLES = {"op4_chat_formatting": chat.SQL, "op11_conversation_prefix_trie": prefixes.SQL}
