"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from siftwell.llm.classifier import op8_quality_classifier
from siftwell.llm.licenses import OP2_SQL, op2_license_scan
from siftwell.llm.lines import OP9_SQL, op9_line_dedup
from siftwell.llm.mixing import OP6_SQL, op6_source_mix
from siftwell.llm.packing import op4_best_fit_packing
from siftwell.llm.periodic import OP13_SQL, op13_periodic_runs
from siftwell.llm.quality_rules import OP1_SQL, op1_quality_rules
from siftwell.llm.setsketch import OP12_SQL, op12_setsketch_near_dedup
from siftwell.llm.simhash import op5_simhash_near_dedup
from siftwell.llm.spelling import OP11_SQL, op11_spelling_variants
from siftwell.llm.suffix_dedup import op3_suffix_dedup
from siftwell.llm.token_counts import op10_token_counts
from siftwell.llm.topk import OP7_SQL, op7_exact_topk

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_setsketch_near_dedup": op12_setsketch_near_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op6_source_mix": OP6_SQL,
    "op7_exact_topk": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_setsketch_near_dedup": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
