"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from llm import op1_segment_topk, op3_arc_to_warc, op9_licenses
from llm.op10_toxicity import op10_toxicity
from llm.op2_suffix_dedup import op2_suffix_dedup
from llm.op4_decontamination import op4_decontamination
from llm.op5_simple8b import op5_simple8b
from llm.op6_packing import op6_packing
from llm.op7_simhash import op7_simhash
from llm.op8_recompression import op8_substring_dedup

QUERIES = {f.__name__: f for f in (op1_segment_topk.op1_segment_topk, op2_suffix_dedup, op3_arc_to_warc.op3_arc_to_warc, op4_decontamination, op5_simple8b, op6_packing, op7_simhash, op8_substring_dedup, op9_licenses.op9_licenses, op10_toxicity)}
ORACLE: dict[str, str] = {"op1_segment_topk": op1_segment_topk.SQL, "op3_arc_to_warc": op3_arc_to_warc.SQL, "op9_licenses": op9_licenses.SQL}
