"""The queries of this subpackage and, where SQL can express one, the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustwatch.llm import query_decontaminate, query_license_scan, query_lm_scoring, query_merkle_manifest, query_near_duplicates, query_periodic_runs, query_pii, query_quality_classifier, query_quality_rules, query_repeated_passages, query_secret_scan, query_source_mix, query_url_filter

_MODULES = (query_near_duplicates, query_repeated_passages, query_license_scan, query_url_filter, query_secret_scan, query_source_mix, query_pii, query_quality_classifier, query_decontaminate, query_quality_rules, query_periodic_runs, query_lm_scoring, query_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {module.NAME: module.query for module in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {module.NAME: module.SQL for module in _MODULES if module.SQL is not None}
