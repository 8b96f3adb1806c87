"""Registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

import corpus_pipeline
from kelpie.llm.centroids import OP12_SQL, op12_centroids
from kelpie.llm.decontamination import op5_decontamination
from kelpie.llm.html_text import op8_html_text
from kelpie.llm.language import op10_language
from kelpie.llm.language_model import op13_language_model
from kelpie.llm.line_dedup import OP4_SQL, op4_line_dedup
from kelpie.llm.near_duplicates import OP9_SQL, op9_jaccard_join
from kelpie.llm.packing import op7_packing
from kelpie.llm.quality_model import op2_quality_model
from kelpie.llm.quality_rules import op6_quality_rules
from kelpie.llm.ranked_search import OP11_SQL, op11_ranked_search
from kelpie.llm.token_files import op3_token_files
from kelpie.llm.toxicity import op1_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_quality_model": op2_quality_model,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language": op10_language,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroids": op12_centroids,
    "op13_language_model": op13_language_model,
}
SQL = {"op4_line_dedup": OP4_SQL, "op9_jaccard_join": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_centroids": OP12_SQL}
