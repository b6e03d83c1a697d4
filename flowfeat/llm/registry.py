"""Queries of this subpackage and the SQL of those that SQL can state."""

from flowfeat.llm.decontaminate import op6_decontamination
from flowfeat.llm.filter_audit import OP13_SQL, op13_filter_audit
from flowfeat.llm.language_id import op10_language_id
from flowfeat.llm.license_scan import op7_license_scan
from flowfeat.llm.line_dedup import OP5_SQL, op5_line_dedup
from flowfeat.llm.ngram_join import op1_ngram_jaccard_join
from flowfeat.llm.outlier_rules import op12_outlier_rules
from flowfeat.llm.packing import op8_best_fit_packing
from flowfeat.llm.periodic_runs import op11_periodic_runs
from flowfeat.llm.quality import op2_quality
from flowfeat.llm.token_counts import op9_token_counts
from flowfeat.llm.url_filter import OP3_SQL, op3_url_filter
from flowfeat.llm.vector_dedup import op4_vector_dedup

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_outlier_rules": op12_outlier_rules,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op5_line_dedup": OP5_SQL, "op13_filter_audit": OP13_SQL}
