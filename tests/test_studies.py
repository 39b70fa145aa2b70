"""A study worked out by hand, and its causality."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import events, features, studies

EVENT = date(2024, 1, 8)
PERIODS = {"development": (date(2024, 1, 1), date(2024, 1, 31))}
EOD = "instrument_id string, date date, open double, high double, low double, close double, volume long, adj_open double, adj_high double, adj_low double, adj_close double, adj_volume long, div_cash double, split_factor double"


def bar(name, day, o, c, volume=1000, split=1.0, div=0.0):
    h, lo = max(o, c) * 1.01, min(o, c) * 0.99
    return (name, day, o, h, lo, c, volume, o, h, lo, c, volume, div, split)


@pytest.fixture(scope="module")
def world(spark):
    """GAPY opens 5 % down at 95 on the event day; SPY barely moves; DIVY pays a dividend that day."""
    schedule = calendar.session_schedule(spark, date(2023, 12, 18), date(2024, 1, 12))
    days = [r.session_date for r in schedule.orderBy("session_date").collect()]
    rows = []
    for d in days:
        for name in ("GAPY", "DIVY"):
            if d < EVENT:
                rows.append(bar(name, d, 100.0, 100.0 + days.index(d) % 2 * 0.5 * (d < EVENT - timedelta(4))))
            else:
                rows.append(bar(name, d, 95.0 if d == EVENT else 98.0, 98.0, div=1.0 if name == "DIVY" and d == EVENT else 0.0))
        rows.append(bar("SPY", d, 499.0 if d == EVENT else 500.0, 500.0))
    closes = {10: 96.0, 11: 97.0, 12: 97.5, 13: 96.5, 14: 98.5, 15: 98.0}
    hourly = []
    for hour, close in closes.items():
        ts = datetime(2024, 1, 8, hour + 5)
        hourly.append(("GAPY", ts, 95.5, close + 0.5, 95.0, close, 10))
        if hour not in (13, 14):
            hourly.append(("DIVY", ts, 95.5, close + 0.5, 95.0, close, 10))
        hourly.append(("SPY", ts, 500.0, 502.0, 498.0, 501.0, 10))
    hourly.append(("DIVY", datetime(2024, 1, 8, 18), 95.5, 90.0, 95.0, 96.0, 10))  # its high is below its low
    eod = spark.createDataFrame(rows, EOD)
    return eod, spark.createDataFrame(hourly, "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"), schedule


def candidates_of(eod, schedule):
    feat = features.eod_features(eod, 6)
    none = eod.select("instrument_id", "date", F.lit(1.0).alias("hourly_density"))
    return studies.gap_candidates(feat, schedule, none, "SPY", 6, -0.03, 0.0, PERIODS)


def test_hand_worked_observations(spark, world):
    eod, hourly, schedule = world
    found = candidates_of(eod, schedule)
    assert sorted((r.instrument_id, r.event_date) for r in found.collect()) == [("DIVY", EVENT), ("GAPY", EVENT)]
    obs = studies.gap_observations(found, hourly, eod, schedule, "SPY", 0.01)
    gapy = {r.observation_label: r for r in obs.filter("instrument_id = 'GAPY'").collect()}
    assert len(gapy) == 7
    first = gapy["11:00_close_of_10:00_bar"]
    assert first.gap_return == pytest.approx(-0.05) and first.measured_return == pytest.approx(96 / 95 - 1)
    assert first.gap_recovered_fraction == pytest.approx(0.2) and first.benchmark_return == pytest.approx(501 / 499 - 1)
    assert first.available == datetime(2024, 1, 8, 16)
    assert gapy["14:00_close_of_13:00_bar"].max_high == 98.0 and gapy["session_close"].checkpoint_price == 98.0
    divy = {r.observation_label: r for r in obs.filter("instrument_id = 'DIVY'").collect()}
    assert all(r.gap_recovered_fraction is None for r in divy.values())
    missing = {k for k, r in divy.items() if r.outcome_status == "missing_outcome"}
    assert missing == {"14:00_close_of_13:00_bar", "15:00_close_of_14:00_bar"}
    assert divy["15:00_close_of_14:00_bar"].max_high == 98.0  # extremes so far need no bar at the checkpoint
    totals = {r.observation_label: r for r in studies.summarize(obs, ["observation_label"]).collect()}
    assert totals["14:00_close_of_13:00_bar"].hit_rate_target == 1.0 and totals["14:00_close_of_13:00_bar"].hit_rate_target_missing_as_miss == 0.5


def test_decisions_do_not_see_their_day(spark, world):
    eod, _, schedule = world
    later = F.col("date") >= F.lit(EVENT)
    wild = {c: F.when(later, F.col(c) * 3).otherwise(F.col(c)) for c in ("close", "high", "adj_close", "adj_high")}
    shaken = eod.withColumns(wild | {"volume": F.when(later, F.lit(999_999_999)).otherwise(F.col("volume"))})
    a = features.eod_features(eod, 6).filter(F.col("date") <= F.lit(EVENT)).collect()
    b = features.eod_features(shaken, 6).filter(F.col("date") <= F.lit(EVENT)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_selection_contract_sees_changes(spark, world):
    eod, _, schedule = world
    found = candidates_of(eod, schedule)
    same = events.selection_contract(found, found.filter("instrument_id = 'GAPY'")).first()
    assert (same.not_candidates, same.changed, same.not_selected) == (0, 0, 1)
    other = events.selection_contract(found, found.withColumn("open_raw", F.col("open_raw") + 1)).first()
    assert other.changed == 2


def test_short_lookback_is_refused(world):
    with pytest.raises(ValueError):
        features.eod_features(world[0], 1)
