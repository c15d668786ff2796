"""The checked queries of this folder and their SQL twins."""

from __future__ import annotations

from riskgraph.llm import decontaminate, phrases, vector_codes
from riskgraph.llm.bpe import op13_bpe
from riskgraph.llm.decontaminate import op5_decontaminate
from riskgraph.llm.lm_scoring import op9_lm_scoring
from riskgraph.llm.packing import op4_packing
from riskgraph.llm.phrases import op12_phrases
from riskgraph.llm.pii import op3_pii
from riskgraph.llm.quality_classifier import op7_quality_classifier
from riskgraph.llm.quality_rules import op8_quality_rules
from riskgraph.llm.secret_scan import op1_secret_scan
from riskgraph.llm.simhash import op2_simhash
from riskgraph.llm.toxicity import op6_toxicity
from riskgraph.llm.url_filter import op10_url_filter
from riskgraph.llm.vector_codes import op11_vector_codes

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_pii, op4_packing, op5_decontaminate,
                              op6_toxicity, op7_quality_classifier, op8_quality_rules,
                              op9_lm_scoring, op10_url_filter, op11_vector_codes, op12_phrases, op13_bpe)}
ORACLES: dict[str, str] = {"op5_decontaminate": decontaminate.SQL, "op11_vector_codes": vector_codes.SQL,
                           "op12_phrases": phrases.SQL}
