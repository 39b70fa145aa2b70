"""Steps whose cost must grow no faster than the tables: what their plans move and hold."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from barlake.operators import identity, ingest
from barlake.plans import registry
from barlake.plans.frames import Frames
from barlake.sources import derive
from barlake.sources.warehouse import Warehouse

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_and_features_move_once_in_partitions_that_follow_the_rows(spark, monkeypatch):
    few = Frames(spark, SF)
    assert few.partitions is None and plan(few.feat_l).count("Exchange hashpartitioning(instrument_id") == 1
    before = {tuple(r) for r in few.feat_l.collect()}
    monkeypatch.setattr(derive, "ROWS_EACH", 500)
    many = Frames(spark, SF)
    assert many.partitions == -(-many.read("lineitem").count() // 500)
    assert many.feat_l.rdd.getNumPartitions() == many.partitions and {tuple(r) for r in many.feat_l.collect()} == before


def test_dirty_bars_are_derived_once_and_episodes_share_their_partitions(spark, monkeypatch):
    monkeypatch.setattr(derive, "ROWS_EACH", 500)
    t = Frames(spark, SF)
    assert plan(t.dirty).count("FileScan") == 1
    found = plan(registry.queries()["episode_quarantine"](spark, SF))
    assert "hashpartitioning(instrument_id#" in found and set(re.findall(r"hashpartitioning\(instrument_id#\d+, (\d+)\)", found)) == {str(t.partitions)}


def test_outcomes_of_later_sessions_are_not_joined_by_day(spark):
    assert not re.search(r"Join \[instrument_id#\d+, (target_date|event_date)", plan(Frames(spark, SF).obs_multi))


def test_tickers_as_of_a_day_explode_no_spans(spark):
    day = datetime.date
    aliases = [("A", "x", day(2024, 1, 1), day(2024, 1, 9)), ("A", "x", day(2024, 1, 5), day(2024, 1, 12)), ("A", "y", day(2024, 1, 11), day(2024, 1, 20)), ("A", "z", day(2024, 2, 9), day(2024, 2, 1)),
               ("B", None, day(2024, 1, 1), day(2024, 1, 9)), ("C", "x", None, day(2024, 1, 9)), (None, "x", day(2024, 1, 1), day(2024, 1, 9))]
    bars = [("A", day(2024, 1, d), float(d)) for d in (1, 9, 10, 11, 12, 13, 20, 21, 21)] + [("A", day(2024, 2, 5), 0.0), ("B", day(2024, 1, 2), 1.0), ("C", day(2024, 1, 2), 1.0), (None, day(2024, 1, 2), 1.0), ("A", None, 1.0)]
    got = identity.alias_asof(spark.createDataFrame(bars, "instrument_id string, date date, close double"), spark.createDataFrame(aliases, "instrument_id string, ticker string, start_date date, end_date date"))
    assert "Generate" not in plan(got) and got.columns == ["instrument_id", "date", "close", "ticker"]
    rows = got.collect()
    want = {1: "x", 9: "x", 10: "x", 11: None, 12: None, 13: "y", 20: "y", 21: None}
    assert len(rows) == len(bars) and all(r.ticker == (want[r.date.day] if r.instrument_id == "A" and r.date and r.date.month == 1 else None) for r in rows)


def test_publications_compare_whole_rows_only_where_keys_repeat(spark, tmp_path, monkeypatch):
    def unwanted(*_):
        raise AssertionError("rows without repeated keys are not compared")

    bars = Frames(spark, SF).long.filter("instrument_id < 'S3'")
    w = Warehouse(spark, f"file://{tmp_path}/store")
    with monkeypatch.context() as m:
        m.setattr(ingest, "duplicate_conflicts", unwanted)
        m.setattr(ingest, "merge_upsert", unwanted)
        w.publish("eod", bars)
    assert sorted(map(tuple, w.read("eod").collect())) == sorted(map(tuple, bars.collect()))
    w.publish("eod", bars.union(bars))
    assert w.read("eod").count() == bars.count()
    with pytest.raises(ValueError, match="keys conflict"):
        w.publish("eod", bars.union(bars.withColumn("close", F.col("close") + 1)))
