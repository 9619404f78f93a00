"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from firnline.llm.bpe import op4_byte_bpe
from firnline.llm.chosen_path import op8_near_dedup
from firnline.llm.fingerprints import op12_fingerprints
from firnline.llm.grace import OP2_SQL, op2_exact_dedup
from firnline.llm.html_text import op9_html_text
from firnline.llm.mixing import op1_mixing
from firnline.llm.phrases import OP11_SQL, op11_phrases
from firnline.llm.quality import OP3_SQL, op3_quality_rules
from firnline.llm.rans import op10_token_blocks
from firnline.llm.suffix_dedup import op5_suffix_dedup
from firnline.llm.toxicity import op6_toxicity
from firnline.llm.url_lists import OP7_SQL, op7_url_lists
from firnline.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_url_lists": op7_url_lists,
    "op8_near_dedup": op8_near_dedup,
    "op9_html_text": op9_html_text,
    "op10_token_blocks": op10_token_blocks,
    "op11_phrases": op11_phrases,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op7_url_lists": OP7_SQL,
    "op11_phrases": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
