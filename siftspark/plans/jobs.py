"""Composite jobs: each runs some queries and writes their results, one folder per result, with an inventory.

    python -m siftspark.plans.jobs JOB INPUT_FOLDER OUTPUT_FOLDER

An output folder that exists is an error. A job's stages are the queries of the operator modules, so a job fails where
an assertion of theirs does.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from siftspark.operators import (
    aggregates, conformal, files, joins, learning, lsh, metrics, predicates, prom, scalars, sets, statistics, validation, windows,
)
from siftspark.sources import sinks

_ALL = {}
for _m in (aggregates, conformal, files, joins, learning, lsh, metrics, predicates, prom, scalars, sets, statistics, validation, windows):
    _ALL.update(_m.QUERIES)

#: What each job writes: result name -> query.
JOBS: dict[str, dict[str, str]] = {
    "corpus_audit": {"files": "agg_file_audit", "top_projects": "limit_k", "project_overlap": "join_project_overlap"},
    "split_manifest": {"deduplicated": "agg_dedup_first_conflict", "audit": "agg_dedup_audit", "summary": "agg_split_summary", "roles": "bucket_role"},
    "feature_cache": {"located": "scan_locator_lookup", "features": "ml_hash_vectorize"},
    "fold_inputs": {"verified": "join_locator_verify", "positions": "win_dense_position", "packages": "join_logo_exclude", "counts": "agg_fold_counts"},
    "external_cohort": {"source_keys": "agg_prime_key_audit", "unseen": "join_anti_exact_key", "selection": "win_selection_rank", "counts": "agg_project_counts"},
    "embedding_manifest": {"manifest": "set_union_all", "repeated": "val_unique_key"},
    "predict": {"grid": "ml_detector_sgd", "scores": "ml_predict", "density": "ml_crossfit_density"},
    "merge_parts": {"claims": "set_merge_parts", "groups": "set_intersect_union_count"},
    "gate_fit": {"frame": "gate_train_frame", "probabilities": "ml_gate_fit"},
    "evaluate": {"decisions": "eval_fold", "metrics": "met_triage", "gates": "supp_gate", "temperatures": "conf_temperature", "adapter": "prom_adapter", "local_pvalues": "prom_local_experts", "lac_matched": "conf_lac_matched_sets"},
    "analyse": {"comparisons": "stat_paired_comparisons", "detectors": "agg_detector_perf", "discrimination": "stat_gate_discrimination", "support": "agg_support_summary_v1"},
    "calibration_sensitivity": {"sample": "win_nested_hash_sample", "summary": "agg_calibration_summary"},
    "near_duplicate_audit": {"candidates": "join_lsh_bands", "flagged": "join_candidate_docs", "targets": "agg_flagged_targets", "projects": "agg_affected_projects", "clean": "join_anti_flagged", "counts": "agg_counts", "tokens": "agg_token_summary"},
    "near_duplicate_sensitivity": {"summary": "agg_neardup_summary"},
    "efficiency_audit": {"fits": "agg_executed_fits", "runtimes": "agg_runtime_summary"},
    "evidence": {"methods": "agg_method_summary", "gates": "agg_gate_summary", "deltas": "agg_delta_counts", "intervals": "stat_bootstrap_median", "strata": "stat_bootstrap_strata"},
    "validate": {"unique": "val_unique_key", "grid": "val_grid_complete", "bounds": "val_bounds", "seal": "val_seal", "derived": "val_rederive_summary", "gates": "val_gate_summary", "banned": "val_banned_columns", "inputs": "val_frozen_inputs"},
    "figures": {"span": "agg_project_automation", "automation": "sink_figures", "coverage": "join_left_support_cov", "pivot": "agg_pivot_detector"},
}


def run(spark: SparkSession, job: str, folder: str, output: str) -> DataFrame:
    """Writes the results of a job and returns the inventory (file, digest, n_bytes), which is written too."""
    for name, query in JOBS[job].items():
        sinks.write_parquet(_ALL[query](spark, folder), f"{output}/{job}/{name}")
    made = sinks.inventory(spark, f"{output}/{job}")
    sinks.write_json(made, f"{output}/{job}-inventory")
    return made


if __name__ == "__main__":
    if len(sys.argv) != 4 or sys.argv[1] not in JOBS:
        sys.exit(f"{__doc__}\nJobs: {', '.join(JOBS)}")
    run(SparkSession.builder.getOrCreate(), *sys.argv[1:])
