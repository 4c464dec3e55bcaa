"""The operators' queries, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from webloom.llm.chat import OP10_SQL, op10_chat
from webloom.llm.exact import OP7_SQL, op7_exact_dedup
from webloom.llm.extract import op9_html
from webloom.llm.lines import op5_lines
from webloom.llm.mix import OP1_SQL, op1_mix
from webloom.llm.pack import op8_pack
from webloom.llm.quality import op4_quality
from webloom.llm.simhash import op3_simhash
from webloom.llm.spotsigs import op2_spotsigs
from webloom.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_mix": op1_mix,
    "op2_spotsigs": op2_spotsigs,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_lines": op5_lines,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pack": op8_pack,
    "op9_html": op9_html,
    "op10_chat": op10_chat,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_mix": OP1_SQL, "op6_warc": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op10_chat": OP10_SQL}
