"""Thresholds of the detectors: the one place that states them.

Fixed values: each decides a structural or domain call, so results depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARAMETERS = {
    "orf_min_aa": 40.0,
    "domain_evalue_max": 1e-3,
    "domain_orfs_scanned_max": 12.0,
    "ltr_seed_k": 13.0,
    "ltr_min_len": 80.0,
    "ltr_min_anchors": 4.0,
    "ltr_min_identity_pct": 80.0,
    "tir_seed_k": 11.0,
    "tir_min_len": 10.0,
    "tir_max_len": 1000.0,
    "tir_min_anchors": 3.0,
    "tir_min_identity_pct": 80.0,
    "tsd_min_len": 2.0,
    "tsd_max_len": 12.0,
    "polya_min_run": 8.0,
    "pbs_search_window": 44.0,
    "pbs_min_identity": 0.55,
    "ppt_window": 30.0,
    "ppt_min_len": 9.0,
    "ppt_min_purine": 0.82,
    "ppt_max_defects": 2.0,
}


def detector_parameters(spark: SparkSession) -> DataFrame:
    """One row with a column per threshold, to be attached to results and sealed with them."""
    return spark.createDataFrame([tuple(PARAMETERS.values())], ", ".join(f"{name} double" for name in PARAMETERS))


def value(name: str) -> float | int:
    v = PARAMETERS[name]
    return int(v) if v == int(v) else v
