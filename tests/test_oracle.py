"""Every registered query with SQL, side by side on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from furrow.plans import ORACLES, QUERIES
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"

# One query per family keeps the suite short; tools/check_oracle.py runs all of them.
NAMES = [
    "a01_temporal_composite", "a05_change_detection", "a08_lee_filter", "a13_connected_regions", "a17_class_median_imputation", "a19_coverage_minimum",
    "a29_label_quality_suite", "c01_double_logistic_grid_fit", "c05_fused_products", "e11_in_space_placebo", "j04_interval_join", "j05_points_near_track",
    "j10_near_duplicate_points", "j17_reference_counts", "m01_stratified_split", "p04_name_normalisation", "s02_track_csv_scan", "s12_track_line_sink", "s15_partition_refresh",
    "s09_managed_table_sink", "s14_resume_pending_units", "w12_breakpoint_percentile", "p04_candidate_spellings", "e07_wild_cluster_bootstrap", "e16_power_curve", "c04_replicate_date_intervals",
    "c06_penalised_smoother", "e09_leave_one_cluster_out_blocks", "a31_confusion_rows", "a27_three_gate_check", "a27_passing_panel", "a30_panel_quality_suite",
    "u03_run_difference", "w05_threshold_crossing_date", "w10_sequential_ids", "w13_track_line_parts",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    status, _, _, detail = compare(spark, name, QUERIES[name], ORACLES[name], SF, con)
    assert status == "ok", detail


def test_every_inventory_id_has_a_query():
    ids = {"s": 16, "p": 23, "j": 17, "a": 36, "w": 15, "t": 4, "u": 4, "c": 7, "e": 23, "m": 9}
    have = " ".join(QUERIES).replace("m02_m03", "m02 m03")
    missing = [f"{k}{i:02d}" for k, n in ids.items() for i in range(1, n + 1) if f"{k}{i:02d}" not in have]
    assert not missing
    assert set(ORACLES) <= set(QUERIES)
