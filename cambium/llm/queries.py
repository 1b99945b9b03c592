"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cambium.llm import topk
from cambium.llm.decontaminate import op2_decontaminate
from cambium.llm.language import op8_language
from cambium.llm.mixing import op4_mixing
from cambium.llm.pii import op3_pii
from cambium.llm.quality import op10_quality
from cambium.llm.secrets import op5_secrets
from cambium.llm.simhash import op7_simhash
from cambium.llm.substrings import op1_substrings
from cambium.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_topk": topk.op9_topk,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op9_topk": topk.ORACLE}
