"""Two-phase runs over a small warehouse: what selection may read, what is frozen, and what breaks a run."""

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import phases
from barlake.operators.catalog import Catalog
from barlake.operators.phases import Gate, Lookback, Study
from barlake.operators.studies import EVENT
from barlake.sources import warehouse
from tests.test_studies import EOD, bar

INTRADAY = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
ALIASES = "instrument_id string, ticker string, start_date date, end_date date"
DAY = date(2024, 1, 10)
CHECKS = ("duplicate_keys", "ohlc_invariants", "negative_values")


def put(spark, store, skip=()):
    days, hours = [], []
    for day, opened, *_ in calendar.sessions(date(2024, 1, 2), date(2024, 1, 12)):
        for name in ("A", "B", "C", "D"):
            if (name, day) not in skip:
                days.append(bar(name, day, 10.0, 11.0))
                if name != "B":
                    hours.append((name, opened + timedelta(minutes=30), 10.0, 12.0, 9.0, 11.0, 5))
    store.publish("eod", spark.createDataFrame(days, EOD))
    store.publish("intraday_1hour", spark.createDataFrame(hours, INTRADAY))
    names = [(n, n, date(2020, 1, 1), date(2025, 1, 1)) for n in ("A", "B", "C")]  # D has no name
    store.put_metadata("aliases", spark.createDataFrame(names, ALIASES))


def filled(spark, folder):
    store = warehouse.Warehouse(spark, f"file://{folder}/store")
    put(spark, store, skip={("C", date(2024, 1, 5))})  # C misses a day of its lookback
    return store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return filled(spark, tmp_path_factory.mktemp("phases"))


@pytest.fixture
def own(spark, tmp_path):
    """A store that the test changes."""
    return filled(spark, tmp_path)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/research")


def candidates(context):
    rows = context.read("eod").filter(F.col("date") == F.lit(DAY)).select("instrument_id", F.col("date").alias("event_date"), "open")
    return rows.withColumns({"decision_ts": F.lit(datetime(2024, 1, 10, 15)), "first": F.lit(date(2024, 1, 4)), "last": F.lit(date(2024, 1, 9))})


def observe(context, selected):
    hours = context.read("intraday_1hour").select("instrument_id", F.col("ts").cast("date").alias("event_date"), "close").join(selected.select(*EVENT), EVENT, "left_semi")
    rows = selected.join(hours, EVENT, "left").withColumns({"observation_label": F.lit("first"), "outcome_status": F.when(F.col("close").isNull(), "missing_outcome").otherwise("evaluable")})
    return rows, context.spark.createDataFrame([("mean", 1.5, "", {"k": "v"})], phases.METRICS)


STUDY = Study(
    "small", 1, ("eod",), ("intraday_1hour",), (Lookback("eod", "first", "last"),), Gate(CHECKS, ("eod",), "2024-01-02", "2024-01-12"),
    candidates, lambda context, eligible: eligible, observe, (date(2024, 1, 2), date(2024, 1, 12)),
)


def failed(catalog, store, study, error, text):
    with pytest.raises(error, match=text):
        phases.run(study, store, catalog, {"k": 1})
    (record,) = [catalog.record(r) for r in warehouse.files.names(store.spark, catalog.root)]
    assert record["status"] == "failed" and text.split()[0] in record["error"]
    assert warehouse.files.names(store.spark, f"{catalog.root}/{record['run_id']}") == ["run.json"]  # nothing is published


def test_a_run_counts_what_it_did(store, catalog):
    run_id = phases.run(STUDY, store, catalog, {"k": 1})
    rows = {r.instrument_id: r.outcome_status for r in catalog.load_observations([run_id]).collect()}
    assert rows == {"A": "evaluable", "B": "missing_outcome"}
    found = {(r.metric_name.removeprefix(phases.RESERVED), r.dimensions.get("severity")): r.value for r in catalog.metrics(run_id).collect()}
    want = {"candidates": 4, "eligible": 2, "identity_excluded": 1, "calendar_excluded": 0, "lookback_incomplete": 1, "selected": 2, "evaluable": 1, "missing_outcome": 1}
    assert {k: found[k, None] for k in want} == want and found["mean", None] == 1.5
    assert found["quality_findings", "error"] == 0 and catalog.record(run_id)["parameters"][phases.RUNNER]["selection"] == ["eod"]


def test_outcomes_are_sealed_while_events_are_chosen(store, catalog):
    peek = replace(STUDY, select=lambda context, eligible: eligible.join(context.read("intraday_1hour").select("instrument_id").distinct(), "instrument_id", "left_semi"))
    failed(catalog, store, peek, phases.Sealed, "intraday_1hour is not open")


@pytest.mark.parametrize("select,text", [
    (lambda c, e: e.withColumn("open", F.col("open") + 1), "selected events: 2 changed events"),
    (lambda c, e: e.unionByName(e.limit(1).withColumn("instrument_id", F.lit("C"))), "selected events: 1 events that are not eligible"),
    (lambda c, e: e.unionByName(e), "selected events: 2 repeated events"),
    (lambda c, e: e.drop("open"), "selected events have other columns"),
])
def test_selected_events_are_unchanged_candidates(store, catalog, select, text):
    failed(catalog, store, replace(STUDY, select=select), phases.ContractError, text)


@pytest.mark.parametrize("change,text", [
    (lambda df: df.unionByName(df), "candidates: 8 rows of repeated events"),
    (lambda df: df.withColumn("last", F.col("event_date")), "candidates: 4 reversed or late"),
    (lambda df: df.withColumn("first", F.lit(date(2024, 1, 10))), "candidates: 4 reversed or late"),
    (lambda df: df.withColumn("instrument_id", F.concat(F.lit(" "), "instrument_id")), "candidates: 4 blank ids"),
    (lambda df: df.withColumn("decision_ts", F.lit(None).cast("timestamp_ntz")), "candidates: 4 missing decision"),
    (lambda df: df.drop("decision_ts"), "candidates lack decision_ts"),
    (lambda df: df.withColumns({"first": F.lit(date(2024, 1, 6)), "last": F.lit(date(2024, 1, 7))}), "candidates: 4 lookbacks without an expected bar"),
])
def test_candidates_keep_their_contract(store, catalog, change, text):
    failed(catalog, store, replace(STUDY, candidates=lambda context: change(candidates(context))), phases.ContractError, text)


@pytest.mark.parametrize("change,text", [
    (lambda df: df.filter("outcome_status = 'evaluable'"), "observations: 1 dropped events"),
    (lambda df: df.unionByName(df.withColumn("instrument_id", F.lit("C"))), "observations: 1 events that were not selected"),
    (lambda df: df.unionByName(df), "observations: 2 events with repeated labels"),
    (lambda df: df.withColumn("outcome_status", F.lit("good")), "observations: 2 unknown statuses"),
    (lambda df: df.withColumn("observation_label", F.lit(" ")), "observations: 2 null or blank labels"),
])
def test_observations_hold_every_selected_event(store, catalog, change, text):
    def changed(context, selected):
        rows, metrics = observe(context, selected)
        return change(rows), metrics

    failed(catalog, store, replace(STUDY, observe=changed), phases.ContractError, text)


def test_metric_names_of_the_run_are_reserved(store, catalog):
    own = lambda context, selected: (observe(context, selected)[0], context.spark.createDataFrame([("event_audit.selected", 1.0, "", {})], phases.METRICS))
    failed(catalog, store, replace(STUDY, observe=own), phases.ContractError, "metrics: 1 reserved metric names")


def test_a_failed_gate_publishes_nothing(spark, own, catalog):
    bad = bar("A", DAY, 10.0, 11.0)
    own.publish("eod", spark.createDataFrame([bad], EOD).withColumn("volume", F.lit(-1).cast("long")))
    failed(catalog, own, STUDY, phases.GateError, "quality gate: negative_values found 1 on eod")
    with pytest.raises(ValueError):
        phases.run(replace(STUDY, gate=Gate(("nothing",), ("eod",), "2024-01-02", "2024-01-12")), own, catalog, {})


def test_a_run_sees_what_was_there_at_its_start(spark, own, catalog):
    def publishing(context, selected):
        hours = [("B", datetime(2024, 1, 10, 15), 10.0, 12.0, 9.0, 11.0, 5)]
        own.publish("intraday_1hour", spark.createDataFrame(hours, INTRADAY))
        return observe(context, selected)

    run_id = phases.run(replace(STUDY, observe=publishing), own, catalog, {})
    assert {r.instrument_id: r.outcome_status for r in catalog.load_observations([run_id]).collect()}["B"] == "missing_outcome"
    assert {r.instrument_id: r.outcome_status for r in catalog.load_observations([phases.run(STUDY, own, catalog, {})]).collect()}["B"] == "evaluable"


def test_fingerprints_name_what_changed(spark, own, catalog):
    run_id = phases.run(STUDY, own, catalog, {})
    names = lambda: {"aliases": own.metadata("aliases")}
    assert catalog.verify(run_id, own, names()).matches
    again = own.read("eod")
    own.publish("eod", again)  # the same rows in other files
    assert catalog.verify(run_id, own, names()).matches
    own.put_metadata("aliases", own.metadata("aliases").filter("ticker <> 'C'"))
    status = catalog.verify(run_id, own, names())
    assert status.metadata_changed == ("aliases",) and not status.matches and status.counts.get("changed", 0) == 0
    own.publish("eod", spark.createDataFrame([bar("A", DAY, 10.0, 11.5), bar("E", DAY, 10.0, 11.0)], EOD))
    status = catalog.verify(run_id, own)
    assert (status.counts["changed"], status.counts["added"]) == (1, 1) and not status.metadata_changed
    changed = {r.path: r.status for r in catalog.differences(run_id, own).filter("status <> 'unchanged'").collect()}
    assert changed == {f"eod/bucket={warehouse.bucket_of('A')}": "changed", f"eod/bucket={warehouse.bucket_of('E')}": "added"}


def test_abandoned_work_is_reported_before_it_is_removed(spark, store, catalog):
    run_id = phases.run(STUDY, store, catalog, {})
    fs = warehouse.files
    catalog._write(f"{catalog.root}/r1/run.json", {"run_id": "r1", "status": "running"}, overwrite=False)
    spark.range(1).write.parquet(f"{catalog.root}/r1/_candidates")
    spark.range(1).write.parquet(f"{catalog.root}/r2/observations")
    fs.remove(spark, f"{catalog.root}/{run_id}/metrics")
    found = {"r1": "running", "r2": "without_record", run_id: "missing_artifact"}
    assert catalog.reconcile() == found and set(fs.names(spark, catalog.root)) == {"r1", "r2", run_id}
    assert catalog.reconcile(apply=True) == found
    assert fs.names(spark, f"{catalog.root}/r1") == ["run.json"] and catalog.record("r1")["status"] == "failed" and "r2" not in fs.names(spark, catalog.root)
    assert catalog.reconcile() == {run_id: "missing_artifact"} and catalog.record(run_id)["status"] == "succeeded"


def lookbacks(spark, rows, bars, dataset, kind):
    found = spark.createDataFrame(rows, f"instrument_id string, event_date date, a {kind}, b {kind}")
    labels = spark.createDataFrame(bars, f"instrument_id string, label {kind}")
    schedule = calendar.session_schedule(spark, date(2023, 12, 20), date(2024, 1, 20))
    from barlake.operators import events

    return {r.instrument_id: (r.expected, r.matched, r.complete) for r in events.lookback_complete(found, labels, schedule, "a", "b", dataset).collect()}


def test_intraday_lookbacks_need_every_label(spark):
    at = lambda h, m=0, d=4: datetime(2024, 1, d, h, m)
    span = (date(2024, 1, 4), at(14, 30), at(14, 55))
    five = [at(14, m) for m in range(30, 60, 5)]
    rows = [("full", *span), ("gap", *span), ("none", *span), ("off", *span)]
    bars = [("full", t) for t in [at(14, 25), *five, at(15, 0), at(14, 30)]] + [("gap", t) for t in five if t.minute != 45] + [("off", t + timedelta(minutes=1)) for t in five]
    assert lookbacks(spark, rows, bars, "intraday_5min", "timestamp_ntz") == {"full": (6, 6, True), "gap": (6, 5, False), "none": (6, 0, False), "off": (6, 0, False)}
    # hours begin at 10:00 in New York: none is due between 14:30 and 14:55 UTC; over a night and a weekend each session counts
    two = [("empty", *span), ("night", date(2024, 1, 8), at(20, 0, 5), at(16, 0, 8)), ("weekend", date(2024, 1, 8), at(3, 0, 6), at(3, 0, 7))]
    held = [("night", at(20, 0, 5)), ("night", at(15, 0, 8)), ("night", at(16, 0, 8)), ("night", at(17, 0, 8))]
    assert lookbacks(spark, two, held, "intraday_1hour", "timestamp_ntz") == {"empty": (0, 0, False), "night": (3, 3, True), "weekend": (0, 0, False)}


def test_daily_lookbacks_count_sessions(spark):
    d = lambda n: date(2024, 1, n)
    rows = [("a", d(10), d(4), d(9)), ("b", d(10), d(6), d(7)), ("c", d(10), d(9), d(4)), ("e", d(10), d(5), d(8))]
    bars = [("a", d(n)) for n in (3, 4, 5, 6, 8, 9, 9)] + [("e", d(5))]
    assert lookbacks(spark, rows, bars, "eod", "date") == {"a": (4, 4, True), "b": (0, 0, False), "c": (0, 0, False), "e": (2, 1, False)}


def test_no_candidates_publish_an_empty_run(store, catalog):
    run_id = phases.run(replace(STUDY, candidates=lambda context: candidates(context).filter("open < 0")), store, catalog, {})
    assert catalog.load_observations([run_id]).count() == 0
    assert {r.value for r in catalog.metrics(run_id).filter("metric_name LIKE 'event_audit%'").collect()} == {0.0}
