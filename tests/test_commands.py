"""The commands over a small warehouse, and a published study from end to end."""

import json
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from barlake.__main__ import main
from barlake.functions import calendar
from barlake.operators.catalog import Catalog
from barlake.sources import warehouse
from tests.test_studies import EOD, bar

INTRADAY = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
EVENT = date(2024, 1, 8)
PARAMETERS = {
    "start": "2024-01-02", "end": "2024-01-12", "lookback_sessions": 6, "min_adv_dollars": 0, "periods": {"all": ["2024-01-01", "2024-01-31"]}, "metric_periods": ["all"], "benchmark_ticker": "spy",
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('commands')}"
    store = warehouse.Warehouse(spark, root)
    days, hours = [], []
    utc = lambda d, h: datetime(d.year, d.month, d.day, h, tzinfo=ZoneInfo("America/New_York")).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
    for n, (day, *_) in enumerate(calendar.sessions(date(2023, 12, 15), date(2024, 1, 26))):
        for name in ("GAPY", "SPY"):
            start = 95.0 if name == "GAPY" and day == EVENT else 100.0
            close = 98.0 if name == "GAPY" and day == EVENT else 100.0 + n % 2 / 10
            days.append(bar(name, day, start, close))
            hours += [(name, utc(day, h), start, close + 1, start - 1, start + h / 10 - 0.9, 5) for h in range(10, 16)]
    store.publish("eod", spark.createDataFrame(days, EOD))
    store.publish("intraday_1hour", spark.createDataFrame(hours, INTRADAY))
    store.put_metadata("aliases", spark.createDataFrame([(n, n, date(2020, 1, 1), date(2025, 1, 1)) for n in ("GAPY", "SPY")], "instrument_id string, ticker string, start_date date, end_date date"))
    return root


def test_status_and_sql(root, capsys):
    assert main([root, "status"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["dataset"], r["instruments"]) for r in rows] == [("eod", 2), ("intraday_1hour", 2)] and rows[1]["rows"] == 6 * rows[0]["rows"]
    assert main([root, "sql", "SELECT ticker, count(*) AS n FROM eod JOIN meta_aliases USING (instrument_id) GROUP BY 1 ORDER BY 1"]) == 0
    assert "GAPY" in capsys.readouterr().out
    assert main([root, "sql", "SELECT nothing FROM nowhere"]) == 2


def test_quality_fails_by_what_it_finds(spark, root, capsys, tmp_path):
    assert main([root, "quality", "eod", "duplicate_keys", "ohlc_invariants", "split_sanity"]) == 0
    bad = warehouse.Warehouse(spark, f"file://{tmp_path}/bad")
    bad.publish("eod", spark.createDataFrame([bar("A", EVENT, 1.0, 2.0)], EOD).selectExpr(*[c if c != "split_factor" else "0.0D AS split_factor" for c in (x.split()[0] for x in EOD.split(", "))]))
    capsys.readouterr()
    assert main([bad.root, "quality", "eod", "split_sanity"]) == 1
    assert json.loads(capsys.readouterr().out)["check"] == "split_sanity"
    assert main([root, "quality", "intraday_1hour", "split_sanity"]) == 2


def test_research_run_and_rank(spark, root, capsys):
    assert main([root, "research-run", "gap_recovery", "--parameters", json.dumps(PARAMETERS)]) == 0
    run_id = capsys.readouterr().out.strip().splitlines()[-1]
    seen = {r.observation_label: r for r in Catalog(spark, f"{root}/research").load_observations([run_id]).collect()}
    assert len(seen) == 7 and {(r.instrument_id, r.event_date) for r in seen.values()} == {("GAPY", EVENT)}
    assert abs(seen["session_close"].measured_return - (98 / 95 - 1)) < 1e-12 and abs(seen["11:00_close_of_10:00_bar"].checkpoint_price - 95.1) < 1e-12
    window = ":".join(str(EVENT + timedelta(d)) for d in (-1, 0, 1, 9))
    assert main([root, "research-rank", run_id, "--checkpoint", "session_close", "--window", window]) == 0
    assert "window pairs" in capsys.readouterr().out
    for bad in (["research-run", "none"], ["research-run", "gap_recovery", "--parameters", '{"gap_threshold": 1}'], ["research-rank", "none", "--checkpoint", "x", "--window", window]):
        assert main([root, *bad]) == 2


def test_multiday_run_by_slices(spark, root, capsys):
    store = warehouse.Warehouse(spark, root)
    store.put_metadata("instruments", spark.createDataFrame([("GAPY", "stock"), ("SPY", "etf")], "instrument_id string, asset_type string"))
    assert main([root, "research-run", "gap_recovery_multiday", "--parameters", json.dumps(PARAMETERS)]) == 0
    run_id = capsys.readouterr().out.strip().splitlines()[-1]
    runs = Catalog(spark, f"{root}/research")
    rows = runs.load_observations([run_id]).collect()
    assert {r.observation_label for r in rows} == {f"session_plus_{h}" for h in (0, 1, 2, 3, 5, 10)} and {r.asset_type for r in rows} == {"stock"}
    found = runs.metrics(run_id).filter("metric_name = 'evaluable'").collect()
    assert {tuple(sorted(set(r.dimensions) - {"period", "observation_label"})) for r in found} == {(), ("asset_type",), ("market_regime",), ("market_trend",)}
    assert {r.dimensions["asset_type"] for r in found if "asset_type" in r.dimensions} == {"stock"}
    assert main([root, "research-run", "gap_recovery_multiday", "--parameters", json.dumps(PARAMETERS | {"min_gap_volatilities": 1e9})]) == 0
    assert runs.load_observations([capsys.readouterr().out.strip().splitlines()[-1]]).count() == 0  # a gap of so many volatilities is no event
    assert main([root, "quality", "intraday_1hour"]) in (0, 1) and main([root, "quality", "eod", "missing_expected_sessions", "zero_volume_runs"]) in (0, 1)


def test_group_tags_and_files(spark, root, tmp_path):
    (tmp_path / "tags.csv").write_text("ticker,group\n aa, Tech\nbb,Oil \n")
    (tmp_path / "plain.csv").write_text("cc,Gas\n")
    assert {tuple(r) for r in warehouse.group_tags(spark, str(tmp_path / "tags.csv")).collect()} == {("AA", "Tech"), ("BB", "Oil")}
    assert [tuple(r) for r in warehouse.group_tags(spark, str(tmp_path / "plain.csv")).collect()] == [("CC", "Gas")]
    store = warehouse.Warehouse(spark, root)
    some = store.read("eod", ["SPY"]).inputFiles()
    assert {r.instrument_id for r in store.read_files(some).collect()} == {"SPY"}
