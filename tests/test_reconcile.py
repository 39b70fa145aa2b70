"""Files against coverage, vendor answers with faults, rows set aside, and repaired episodes."""

import uuid
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import episodes, reconcile
from barlake.sources import delivery, warehouse
from tests.test_studies import EOD, bar

INTRADAY = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def test_coverage_is_replaced_in_one_version(spark, tmp_path):
    store = warehouse.Warehouse(spark, f"file://{tmp_path}/store")
    days = [date(2024, 1, d) for d in (2, 3, 4)]
    store.publish("eod", spark.createDataFrame([bar(n, d, 10.0, 11.0) for n in ("A", "B") for d in days], EOD))
    times = [("A", datetime(y, 6, 3, 14, 30)) for y in (2022, 2023, 2024)] + [("B", datetime(y, 6, 3, 14, 30)) for y in (2020, 2023)] + [("C", datetime(2024, 6, 4, 14, 30))]
    store.publish("intraday_5min", spark.createDataFrame([(n, t, 1.0, 1.0, 1.0, 1.0, 1) for n, t in times], INTRADAY))
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "instrument_id string")
    bad = reconcile.replace_coverage(store, known, date(2024, 6, 3))
    assert {(r.instrument_id, r.status) for r in bad.collect()} == {("B", "disconnected_years"), ("C", "current_day_only")}
    held = {(r.instrument_id, r.dataset_key): (r.first_date, r.last_date) for r in store.metadata("coverage").collect()}
    assert held == {("A", "eod"): (days[0], days[-1]), ("B", "eod"): (days[0], days[-1]), ("A", "intraday_5min"): (date(2022, 6, 3), date(2024, 6, 3))}


COLUMNS = ["date", "close", "note"]


def test_answers_are_rows_or_reasons(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿date,close,note\r\n2024-01-02,1.5,\"x, y\"\r\n2024-01-03,2.5,\r\n2024-01-04,3\r\n\r\n2024-01-05,1,2,3\r\n")
    (tmp_path / "b.csv").write_text("note,date,close\nn,2024-01-02,9\nnote,date,close\n")
    (tmp_path / "c.csv").write_text('{"detail": "no such ticker"}\n')
    (tmp_path / "d.csv").write_text("date,other,note\n1,2,3\n")
    (tmp_path / "e.csv").write_text("")
    rows, rejected = delivery.answers(delivery.lines_of(spark, [str(tmp_path)]), COLUMNS)
    name = lambda r: r.file.rsplit("/", 1)[-1]
    got = {(name(r), r.date, r.close, r.note) for r in rows.collect()}
    assert got == {("a.csv", "2024-01-02", "1.5", "x, y"), ("a.csv", "2024-01-03", "2.5", None), ("b.csv", "2024-01-02", "9", "n")}
    reasons = sorted((name(r), r.reason, r.line) for r in rejected.collect())
    assert reasons == [
        ("a.csv", "ragged_row", "2024-01-04,3"), ("a.csv", "ragged_row", "2024-01-05,1,2,3"), ("b.csv", "repeated_header", "note,date,close"),
        ("c.csv", "json_answer", '{"detail": "no such ticker"}'), ("d.csv", "no_header", "1,2,3"), ("d.csv", "no_header", "date,other,note"),
    ]


def test_archives_are_read_where_they_are(spark, tmp_path):
    for name, text in (("one", "date,close,note\n2024-01-02,1,a\n"), ("two", "close,date,note\n2,2024-01-03,b\n2\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("data.csv", text)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows, rejected = delivery.answers(delivery.lines_of_archives(spark, [str(tmp_path)]), COLUMNS)
    assert sorted((r.date, r.close, r.note) for r in rows.collect()) == [("2024-01-02", "1", "a"), ("2024-01-03", "2", "b")]
    assert sorted(r.reason for r in rejected.collect()) == ["ragged_row", "unreadable_archive"]


def test_a_repeated_run_replaces_what_it_set_aside(spark, tmp_path):
    store = warehouse.Warehouse(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([bar("A", date(2024, 1, 2), 10.0, 11.0), bar("B", date(2024, 1, 2), 10.0, 11.0)], EOD)
    store.quarantine(rows, "r1", "bad")
    store.quarantine(rows.filter("instrument_id = 'A'"), "r2", "worse")
    store.quarantine(rows.filter("instrument_id = 'B'"), "r1", "bad")
    held = {(r.run, r.instrument_id, r.quarantine_reason) for r in store.quarantined().collect()}
    assert held == {("r1", "B", "bad"), ("r2", "A", "worse")}
    with pytest.raises(ValueError):
        store.quarantine(rows, "a/b", "bad")


def test_uuid_of_a_name(spark):
    names = ["", "a|b", "market-data-eod-episode-v1|S1|T|1995-01-01|1", "é" * 90]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", episodes.uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: uuid.uuid5(uuid.NAMESPACE_URL, n).hex for n in names}


def test_episodes_are_cut_kept_and_set_aside(spark):
    days = [s[0] for s in calendar.sessions(date(2023, 1, 3), date(2023, 12, 29))]
    rows = []
    put = lambda name, part, **more: rows.extend(bar(name, d, 10.0, 11.0, **more) for d in part)
    put("HOLE", days[:40]), put("HOLE", days[60:120])  # two listings with a hole of 20 sessions
    put("BRIDGE", days[:30]), put("BRIDGE", days[30:45], volume=0), put("BRIDGE", days[45:90])
    put("SHORT", days[:40]), put("SHORT", days[60:65]), put("SHORT", days[90:130])  # five bars are no listing
    put("FEW", days[:3])  # without a boundary nothing is short
    put("ALONE", days[:40]), put("ALONE", days[80:85])
    put("OPENS", days[:15], volume=0), put("OPENS", days[15:60])  # zeroes before the first trade are no bridge
    put("OTHER", days[:10]), put("OTHER", days[100:110])  # no source
    bars = spark.createDataFrame(rows, EOD)
    bars = bars.withColumn("high", F.when((F.col("instrument_id") == "FEW") & (F.col("date") == days[1]), 1.0).otherwise(F.col("high")))
    names = sorted({r[0] for r in rows} - {"OTHER"})
    sources = spark.createDataFrame([(n, n.lower(), date(2020, 1, 1), date(2025, 1, 1)) for n in names], "instrument_id string, ticker string, start_date date, end_date date")
    indexed = calendar.with_index(calendar.session_schedule(spark, days[0], days[-1]))
    found = episodes.assigned(bars, sources, indexed, 10, 20).persist()
    plan = episodes.plan(found)
    got = {(r.source_id, r.ordinal): (r.observed_first, r.observed_last, r.n_bars, r.start_date, r.end_date, r.display_label) for r in plan.collect()}
    start, end = date(2020, 1, 1), date(2025, 1, 1)
    label = lambda name, day: f"{name.lower()}@{day:%Y%m%d}"
    assert got == {
        ("HOLE", 1): (days[0], days[39], 40, start, days[39], label("hole", start)), ("HOLE", 2): (days[60], days[119], 60, days[60], end, label("hole", days[60])),
        ("BRIDGE", 1): (days[0], days[29], 30, start, days[29], label("bridge", start)), ("BRIDGE", 2): (days[45], days[89], 45, days[45], end, label("bridge", days[45])),
        ("SHORT", 1): (days[0], days[39], 40, start, days[39], label("short", start)), ("SHORT", 2): (days[90], days[129], 40, days[90], end, label("short", days[90])),
    }
    name = "|".join([episodes.ANCHOR, "HOLE", "hole", days[60].isoformat(), "2"])
    assert {r.instrument_id for r in plan.filter("source_id = 'HOLE' AND ordinal = 2").collect()} == {uuid.uuid5(uuid.NAMESPACE_URL, name).hex}
    aside = {(r.instrument_id, r.quarantine_reason): r["count"] for r in episodes.quarantined(found, bars.columns).groupBy("instrument_id", "quarantine_reason").count().collect()}
    assert aside == {("BRIDGE", episodes.BRIDGE): 15, ("SHORT", episodes.SHORT): 5, ("ALONE", episodes.SHORT): 5, ("FEW", episodes.INVALID): 1}
    kept = episodes.repaired(found, bars.columns)
    assert kept.count() + sum(aside.values()) == len(rows)
    back = kept.join(plan.select("instrument_id", "source_id"), "instrument_id", "left").withColumn("instrument_id", F.coalesce("source_id", "instrument_id")).select(bars.columns)
    assert back.exceptAll(bars).count() == 0
    # A second repair finds nothing.
    again = episodes.assigned(kept, episodes.repaired_sources(sources, plan), indexed, 10, 20)
    assert episodes.plan(again).count() == 0 and episodes.quarantined(again, bars.columns).count() == 0
    assert episodes.repaired(again, bars.columns).exceptAll(kept).count() == 0
    found.unpersist()
