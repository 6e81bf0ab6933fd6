"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyboard.llm import lexical_search, url_filter, vector_search
from tallyboard.llm.decontamination import op7_decontamination
from tallyboard.llm.html_text import op9_html
from tallyboard.llm.language_id import op3_language_id
from tallyboard.llm.line_dedup import op6_line_dedup
from tallyboard.llm.ngram_join import op8_ngram_join
from tallyboard.llm.packing import op10_packing
from tallyboard.llm.quality import op5_quality
from tallyboard.llm.sharding import op4_sharding
from tallyboard.llm.suffix_dedup import op2_suffix_dedup
from tallyboard.llm.token_alignment import op13_token_alignment

QUERIES = {
    "op1_top_k": vector_search.op1_top_k,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_join": op8_ngram_join,
    "op9_html": op9_html,
    "op10_packing": op10_packing,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_top_k": vector_search.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
}
