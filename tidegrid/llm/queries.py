"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegrid.llm.divergence import OP13_SQL, op13_source_divergence
from tidegrid.llm.fingerprints import op3_fingerprints
from tidegrid.llm.lexical import OP11_SQL, op11_ranked_search
from tidegrid.llm.line_dedup import op1_line_dedup
from tidegrid.llm.mixing import op10_mixing
from tidegrid.llm.near_dedup import op4_near_dedup
from tidegrid.llm.pieces import op9_pieces
from tidegrid.llm.private_numbers import op8_private_numbers
from tidegrid.llm.repeats import op12_suffix_dedup
from tidegrid.llm.token_files import op6_token_files
from tidegrid.llm.topk import OP7_SQL, op7_top_k
from tidegrid.llm.toxicity import op5_toxicity
from tidegrid.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_top_k": op7_top_k,
    "op8_private_numbers": op8_private_numbers,
    "op9_pieces": op9_pieces,
    "op10_mixing": op10_mixing,
    "op11_ranked_search": op11_ranked_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op2_url_filter": OP2_SQL,
    "op7_top_k": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
