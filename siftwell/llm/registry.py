"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from siftwell.llm.decontamination import OP2_SQL, op2_decontamination
from siftwell.llm.embedding_dedup import OP12_SQL, op12_embedding_dedup
from siftwell.llm.filter_audit import OP11_SQL, op11_filter_audit
from siftwell.llm.language_id import op4_language_id
from siftwell.llm.license_scan import op8_license_scan, op8_sql
from siftwell.llm.mixing import OP6_SQL, op6_source_mix
from siftwell.llm.ngram_jaccard import OP3_SQL, op3_ngram_jaccard
from siftwell.llm.quality_classifier import op10_quality_classifier
from siftwell.llm.quality_rules import OP1_SQL, op1_quality_rules
from siftwell.llm.repeat_removal import op9_repeat_removal
from siftwell.llm.source_divergence import OP13_SQL, op13_source_divergence
from siftwell.llm.token_counts import op7_token_counts
from siftwell.llm.token_output import op5_token_output

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language_id": op4_language_id,
    "op5_token_output": op5_token_output,
    "op6_source_mix": op6_source_mix,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_repeat_removal": op9_repeat_removal,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op3_ngram_jaccard": OP3_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_license_scan": op8_sql(),
    "op11_filter_audit": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
