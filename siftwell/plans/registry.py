"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from siftwell.plans import queries as q
from siftwell.plans.oracles import ORACLES as _SQL

_NAMES = """
dense_topk gold_rank dense_recall_mrr mean_top1_sim nn_graph confusion_pairs geometry_probe matrix_gaps
rank_stable rank_worst_tie zscore_per_query nearest_row rerank_replace rerank_depths
tokenize term_stats bm25_topk bm25_subpool bm25_nonzero_frac
fuse_zscore fuse_rrf fuse_rrf_tie fuse_window fuse_full fusion_sweep union_ceiling pool_curve
dedup_queries tool_holdout route_splits group_cap_sample stratified_sample fixed_batches near_dup_cross
confusable_components component_partition partition_audit
bucket_stats headroom headroom_no_reference representation_ratio sign_split best_config pooled_metrics
selector_tally conditional_accuracy run_disagreements mcnemar_exact paired_bootstrap
hard_negatives negative_provenance oracle_shortlist composed_arms rescued_lost shortlist_dedup
humanize_path slug_and_key side_effects doc_quality first_wins redact redaction_counts json_fenced_extract paged_prompts table_digest extract_operations
evaluate_splits matrix_sweep matrix_report random_control alpha_plateau claim_table mean_difference lexical_pool_curve confusion_candidates separable_filters mean_words
fusion_sweep_zscore composed_zscore jsonl_round_trip label_queries plugin_join catalog_pool picked_specs best_gold thin_descriptions paired_arms shared_answers valid_generated
unmatched_labels score_cache training_batches training_batch_audit training_pairs split_registry generation_ledger generated_intents selected_answers
risk_coverage calibration_bins selective_report catalog_drift drift_refresh argument_errors argument_scores
""".split()

QUERIES = {name: getattr(q, name) for name in _NAMES} | {f"doc_text_{v}": q._doc_text(v) for v in ("v0", "v1", "v2", "v3")}

#: Ranks and slots are 32-bit integers in the queries.
_RANKS = {
    "rank": "dense_topk score_cache gold_rank rank_stable rank_worst_tie bm25_topk bm25_subpool best_gold drift_refresh",
    "new_rank": "rerank_replace fuse_rrf fuse_rrf_tie fuse_window fuse_full",
    "pick": "group_cap_sample",
    "slot": "oracle_shortlist",
}
ORACLES = dict(_SQL)
for _column, _queries in _RANKS.items():
    for _name in _queries.split():
        ORACLES[_name] = f"SELECT * REPLACE ({_column}::INTEGER AS {_column}) FROM ({_SQL[_name]})"
