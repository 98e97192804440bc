"""The queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .html_tree import op10_html
from .jaccard_join import op6_jaccard
from .language import op4_language
from .oracles import ORACLES
from .packing import op7_packing
from .pii import op1_pii
from .quality_model import op2_quality
from .rules import op5_rules
from .substrings import op9_substrings
from .warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_decontaminate, op4_language, op5_rules, op6_jaccard, op7_packing, op8_warc, op9_substrings, op10_html)}
__all__ = ["ORACLES", "QUERIES"]  # learned models, tokenizers and archives aren't expressible in SQL; tests/llm holds them against brute force
