"""The subpackage's queries and their SQL."""

from __future__ import annotations

from framewright.llm.byte_cnn import op4_language_id
from framewright.llm.cross_alignment import op12_cross_alignment
from framewright.llm.html_main_text import op8_html_extraction
from framewright.llm.lexical_search import OP11_SQL, op11_lexical_search
from framewright.llm.license_scan import op13_license_scan
from framewright.llm.lm_scoring import op6_lm_scoring
from framewright.llm.near_dedup import op7_near_dedup
from framewright.llm.packing import op9_best_fit_packing
from framewright.llm.quality_ledger import OP3_SQL, op3_quality_rules
from framewright.llm.sentencepiece_codec import op1_sentencepiece
from framewright.llm.token_store import op2_token_store
from framewright.llm.toxicity import op5_toxicity
from framewright.llm.transport_stream import op10_transport_stream

QUERIES = {q.__name__: q for q in (op1_sentencepiece, op2_token_store, op3_quality_rules, op4_language_id, op5_toxicity, op6_lm_scoring, op7_near_dedup, op8_html_extraction, op9_best_fit_packing, op10_transport_stream, op11_lexical_search, op12_cross_alignment, op13_license_scan)}
ORACLES = {"op3_quality_rules": OP3_SQL, "op11_lexical_search": OP11_SQL}
