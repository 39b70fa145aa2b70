"""Registered queries against DuckDB on the smallest tables, and the entry contract."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from barlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "load_eod_by_ticker", "universe_import", "merge_upsert", "snapshot_replace", "quarantine_ohlc", "q_duplicate_keys", "q_zero_volume_runs", "q_missing_sessions", "q_off_session",
    "q_coverage_summary", "quality_gate", "eod_features", "density_hourly", "density_5min", "label_sessions_5min", "coverage_gaps", "refresh_validate", "ledger_usage", "universe_rank",
    "alias_asof", "alias_segments", "identifier_segments", "interval_cover", "coalesce_segments", "episode_zero_bridge", "gap_observations", "gap_study_flagship", "opening_metrics",
    "multiday_metrics", "multiday_path", "identifier_ranges", "plan_segments", "metadata_agreement", "metadata_relations", "read_as_of", "features_colocated", "footer_counts", "q_zero_volume_bars", "quality_findings", "quality_scope",
    "budget_ramp", "cohort_freshness", "request_rate", "retry_progress", "exclusions", "unresolved_listings", "next_session", "lookback_complete", "publish_upsert", "eligibility_audit", "event_funnel", "propensity_two_pass", "propensity_groups", "compare_agreement",
    "request_chunks", "session_schedule", "quality_run", "episode_plan", "episode_quarantine", "manifest_diff", "footer_bounds", "lookback_complete_5min", "lookback_complete_hourly", "run_audit", "reconcile_files", "slice_liquidity_year",
]


def text(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.number)):
            return repr(float(x) + 0.0)
        return str(x).removesuffix(" 00:00:00")

    return sorted((tuple(one(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, duck, name):
    want = duck.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert text(got) == text(want)


def test_entry_contract(spark):
    names = entry_point.queries()
    assert set(entry_point.oracle_sql()) <= set(names) and len(registry.queries()) >= 100
    assert entry_point.entry(spark).columns == ["period", "observation_label", "metric_name", "value"]


def test_one_exchange_and_sort_for_all_feature_windows(spark):
    from barlake.plans.frames import Frames

    plan = Frames(spark, SF).feat_e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instrument_id") <= 2  # the bars' own aggregate and the windows
