"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .classifier import op2_quality_classifier
from .decontaminate import op7_benchmark_decontamination
from .katz import op5_katz_scoring
from .licenses import op10_license_scan
from .mixing import OP13_SQL, op13_source_mixing
from .packing import op1_best_fit_packing
from .quality import OP6_SQL, op6_quality_rules
from .records import op3_token_records
from .resampling import op11_importance_resampling
from .simhash import op4_simhash_near_dedup
from .spelling import op12_spelling_variants
from .substring import op9_substring_dedup
from .toolcalls import OP8_SQL, op8_tool_call_linking

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_records": op3_token_records,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_katz_scoring": op5_katz_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_tool_call_linking": op8_tool_call_linking,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_mixing": op13_source_mixing,
}
SQL: dict[str, str] = {
    "op6_quality_rules": OP6_SQL,
    "op8_tool_call_linking": OP8_SQL,
    "op13_source_mixing": OP13_SQL,
}
