"""The queries of this package and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from changeflow.llm.bpe import op3_bpe
from changeflow.llm.decontaminate import op5_decontaminate
from changeflow.llm.html_extract import op1_html_extract
from changeflow.llm.importance_resampling import OP13_SQL, op13_importance_resampling
from changeflow.llm.jaccard_join import op6_jaccard_join
from changeflow.llm.language_id import op4_language_id
from changeflow.llm.line_dedup import OP10_SQL, op10_line_dedup
from changeflow.llm.lm_scoring import op7_lm_scoring
from changeflow.llm.merkle_manifest import OP11_SQL, op11_merkle_manifest
from changeflow.llm.quality_gam import op8_quality_gam
from changeflow.llm.quality_rules import op9_quality_rules
from changeflow.llm.secret_scan import op2_secret_scan
from changeflow.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_gam": op8_quality_gam,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
