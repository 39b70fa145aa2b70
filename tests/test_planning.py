"""Hand-worked cases of planning, universes, budgets, health and study parameters."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import health, identity, ingest, quality, ranking, registry
from barlake.sources import warehouse


def day(text):
    return date.fromisoformat(text)


def test_overnight_window():
    # Friday 2024-01-12 closes at 21:00 UTC; the window opens at 23:30 and lasts over the holiday on Monday.
    assert calendar.overnight_window(datetime(2024, 1, 12, 23, 29)) is None
    w = calendar.overnight_window(datetime(2024, 1, 14, 12))
    assert (w.session_date, w.opens_at, w.closes_at) == (day("2024-01-12"), datetime(2024, 1, 12, 23, 30), datetime(2024, 1, 16, 13))
    assert calendar.overnight_window(datetime(2024, 1, 16, 13)) is None
    assert calendar.overnight_window(datetime(2024, 7, 9, 11, 59)).closes_at == datetime(2024, 7, 9, 12)  # summer time


@pytest.mark.parametrize("freq,start,end", [("5min", "2023-01-01", "2024-12-31"), ("1hour", "2015-03-04", "2024-02-29"), ("5min", "2024-03-29", "2024-03-29")])
def test_request_chunks_are_the_longest_that_fit(freq, start, end):
    per_day = calendar.FULL_SESSION_BARS[freq]
    chunks = calendar.request_chunks(day(start), day(end), freq)
    assert chunks[0].start == day(start) and chunks[-1].end == day(end)
    assert all(b.start == a.end + timedelta(1) for a, b in zip(chunks, chunks[1:], strict=False))
    count = lambda a, b: sum((a + timedelta(i)).weekday() < 5 for i in range((b - a).days + 1))
    for c in chunks:
        assert c.fetch_end == calendar.next_session_after(c.end) and c.max_rows == count(c.start, c.fetch_end) * per_day < calendar.ROW_CAP
        if c.end < day(end):
            longer = c.end + timedelta(1)
            assert count(c.start, calendar.next_session_after(longer)) * per_day >= calendar.ROW_CAP
    assert calendar.request_chunks(day(start), day(end), freq, reverse=True) == chunks[::-1]
    assert calendar.probe_sessions("5min") == 127 and calendar.weekday_count(day("2024-01-06"), day("2024-01-07")) == 0


DEFAULTS = {
    "start": "2020-01-01", "end": "2023-12-31", "gap_threshold": -0.03, "min_adv_dollars": 0, "lookback_sessions": 20, "min_hourly_density": 0.5, "target_return": 0.01,
    "periods": {"a": ["2020-01-01", "2021-12-31"], "b": ["2022-01-01", "2023-12-31"]}, "metric_periods": ["a"], "benchmark_ticker": " spy ",
}


def test_parameters_are_completed_and_checked():
    p = registry.normalize_parameters({"lookback_sessions": 6}, DEFAULTS, "gap")
    assert p["benchmark_ticker"] == "SPY" and p["lookback_sessions"] == 6 and p["periods"]["b"] == ["2022-01-01", "2023-12-31"]
    bad = [
        {"other": 1}, {"start": "2024-01-01"}, {"gap_threshold": 0}, {"min_adv_dollars": -1}, {"lookback_sessions": 5}, {"min_hourly_density": 1.5}, {"target_return": 0}, {"periods": {}},
        {"periods": {"a": ["2021-01-01", "2020-01-01"]}}, {"periods": {"a": ["2020-01-01", "2021-01-01"], "b": ["2021-01-01", "2022-01-01"]}}, {"metric_periods": ["c"]}, {"benchmark_ticker": " "},
    ]
    for given in bad:
        with pytest.raises(ValueError):
            registry.normalize_parameters(given, DEFAULTS, "gap")


ALIASES = "instrument_id string, ticker string, start_date date, end_date date"


def test_benchmark_is_one_instrument(spark):
    rows = [("A", "SPY", day("2020-01-01"), day("2020-06-30")), ("A", "SPY", day("2020-07-01"), day("2020-12-31")), ("B", "OLD", day("2020-01-01"), day("2020-06-30"))]
    aliases = spark.createDataFrame(rows, ALIASES)
    assert registry.resolve_benchmark(aliases, "SPY", "2020-02-01", "2020-11-30") == "A"
    for ticker, end in (("OLD", "2020-07-01"), ("NONE", "2020-03-01")):
        with pytest.raises(ValueError):
            registry.resolve_benchmark(aliases, ticker, "2020-02-01", end)


def test_studies_are_registered_once(tmp_path):
    registry.register("one", lambda x: x + 1, replace=True)
    assert registry.dispatch("one", 2) == 3 and "one" in registry.registered()
    for call in (lambda: registry.register("one", print), lambda: registry.dispatch("none")):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "mine.py").write_text("from barlake.operators import registry\nregistry.register('mine', lambda: 5, replace=True)\n")
    (tmp_path / "_skip.py").write_text("raise RuntimeError\n")
    assert registry.load_folder(str(tmp_path)) == ("mine",) and registry.dispatch("mine") == 5
    assert registry.load_folder(str(tmp_path / "absent")) == ()


LINES = "line long, year int, ticker string, rank int, dollar_volume double"


def test_universe_import(spark):
    rows = [
        (2, 2020, " aa", None, 5.0), (3, 2020, "bb", 1, 9.0), (4, 2020, "cc", 7, 7.0),  # one rank unknown: all are ranked by volume
        (5, 2021, "x", 3, 1.0), (6, 2021, "X ", 9, 8.0), (7, 2021, "y", 1, None), (8, 2021, "y", 1, None),  # the larger volume stays
        (9, 2022, "p", None, 4.0), (10, 2022, "q", None, 4.0), (11, 2022, "r", None, None),  # ties in the order of lines
    ]
    got = {(r.year, r.ticker): (r["rank"], r.conflicts) for r in ingest.universe_import(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {
        (2020, "AA"): (3, 0), (2020, "BB"): (1, 0), (2020, "CC"): (2, 0), (2021, "X"): (9, 1), (2021, "Y"): (1, 0),
        (2022, "P"): (1, 0), (2022, "Q"): (2, 0), (2022, "R"): (3, 0),
    }
    with pytest.raises(PySparkException):
        ingest.universe_import(spark.createDataFrame([(2, 2020, " ", 1, 1.0)], LINES)).collect()


def test_universe_lists_of_any_header(spark):
    one = ingest.universe_import(warehouse.universe_csv(spark, "ticker,rank\nAAA,2\nBBB,1\n", 2020))
    assert {(r.year, r.ticker, r["rank"]) for r in one.collect()} == {(2020, "AAA", 2), (2020, "BBB", 1)}
    two = ingest.universe_import(warehouse.universe_csv(spark, "Year,Ticker,Median_DollarVolume\n2021,aaa,5\n2021,bbb,9.5\n2022,aaa,\n"))
    assert {(r.year, r.ticker, r["rank"]) for r in two.collect()} == {(2021, "AAA", 2), (2021, "BBB", 1), (2022, "AAA", 1)}
    for text in ("rank\n1\n", "ticker\nA\n", "ticker,year\nA,x\n"):
        with pytest.raises(ValueError):
            warehouse.universe_csv(spark, text)


def test_budget_ramp(spark):
    days = spark.createDataFrame([(day(f"2024-01-{d:02d}"),) for d in (1, 24, 25, 26, 30, 31)], "day date")
    got = {r.day.day: r.byte_limit for r in ingest.budget_ramp(days, 500_000, 1_000_000, 7).collect()}
    assert got == {1: 500_000, 24: 500_000, 25: 500_000, 26: 583_333, 30: 916_666, 31: 1_000_000}
    with pytest.raises(ValueError):
        ingest.budget_ramp(days, 2, 1, 7)


def test_ledger_and_rate(spark):
    at = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    rows = [
        (at(1, 4), 100, 1, True, True, True),  # before the billing month, which begins at 05:00 UTC
        (at(1, 5), 100, 1, True, True, True), (at(19, 13), 100, 7, True, False, False), (at(20, 11), 100, 300, False, False, True), (at(20, 11, 30), 50, 20, True, True, False),
    ]
    attempts = spark.createDataFrame(rows, "ts timestamp_ntz, reserved long, observed long, settled boolean, bytes_known boolean, complete boolean")
    usage = ingest.ledger_usage(attempts, "2024-01-20 12:00:00")
    assert tuple(usage.first()) == (1, 3, 4, 328, 1 + 100 + 300 + 20, 2)  # exactly an hour ago is not within the hour
    assert [tuple(r) for r in health.request_rate(usage, 10, 3).collect()] == [("request_rate", "error", 3, 3, "1/10")]


def test_freshness_counts_every_day_late(spark):
    members = spark.createDataFrame([(f"S{i}", i) for i in range(1, 9)], "instrument_id string, rank int")
    cover = lambda late: spark.createDataFrame([(f"S{i}", day("2024-01-04" if i in late else "2024-01-05")) for i in range(1, 8)], "instrument_id string, last_date date")
    found = lambda late, top: tuple(health.coverage_freshness(members, cover(late), "2024-01-05", top).first())[1:]
    assert found((), 5) == ("warning", 1, 8, "top 0")  # S8 has no coverage
    assert found((2,), 2) == ("error", 2, 8, "top 1") and found((7,), 2) == ("error", 2, 8, "top 0")  # a quarter


def test_retries(spark):
    schema = "last_status string, successful_depth int, attempted_turns int"
    rows = [("current_retry_pending", 0, 5), ("current_retry_pending", 1, 9), ("current_retry_exhausted", 0, 1)] + [("done", 1, 1)] * 30
    assert tuple(health.retry_progress(spark.createDataFrame(rows, schema)).first())[1:] == ("warning", 2, 33, "1 stuck 1 exhausted")
    live = spark.createDataFrame([("active", False, "current_retry_pending"), ("active", True, None), ("done", False, None)], "status string, terminal_blocked boolean, last_status string")
    assert health.only_retries_left(live).first().only_retries and not health.only_retries_left(live.filter("status = 'done'")).first().only_retries


def test_zero_volume_runs(spark):
    sessions = [s[0] for s in calendar.sessions(day("2024-01-02"), day("2024-01-12"))]
    rows = [("A", d, 0) for d in sessions[:3]] + [("A", sessions[3], 5)] + [("A", d, 0) for d in sessions[4:6]] + [("A", day("2024-01-06"), 0)]
    rows += [("B", sessions[0], 0), ("B", sessions[0], -5), ("B", sessions[1], 0), ("B", sessions[1], None), ("B", sessions[2], 0), ("B", sessions[2], 0)]
    bars = spark.createDataFrame(rows, "instrument_id string, date date, volume long")
    indexed = calendar.with_index(calendar.session_schedule(spark, day("2024-01-02"), day("2024-01-12")))
    got = {tuple(r) for r in quality.zero_volume_runs(bars, indexed, 1).collect()}
    assert got == {("A", sessions[0], sessions[2], 3), ("A", sessions[4], sessions[5], 2), ("B", sessions[2], sessions[2], 1)}


def test_zero_volume_bars_within_a_session(spark):
    at = lambda h, m: datetime(2024, 1, 3, h, m)
    rows = [("A", at(14, 30 + 5 * i), 0) for i in range(5)] + [("A", at(15, 5), 0), ("A", at(20, 55), 0), ("A", datetime(2024, 1, 4, 14, 30), 0), ("A", at(22, 0), 0), ("A", at(14, 30), 0)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts timestamp_ntz, volume long")
    schedule = calendar.session_schedule(spark, day("2024-01-02"), day("2024-01-05"))
    got = sorted((r.first_ts, r.last_ts, r.n_bars) for r in quality.zero_volume_bar_runs(bars, schedule, "5min", 1).collect())
    assert got == [(at(14, 30), at(14, 50), 5), (at(15, 5), at(15, 5), 1), (at(20, 55), at(20, 55), 1), (datetime(2024, 1, 4, 14, 30),) * 2 + (1,)]


def test_lookahead_rows(spark):
    rows = spark.createDataFrame([(f"2024-01-0{d}T10:00:00Z",) for d in (2, 3, 4, 5)], "date string")
    assert ingest.target_rows(rows, "2024-01-02", "2024-01-04", "2024-01-05", 10).count() == 3
    for args in (("2024-01-03", "2024-01-04", "2024-01-05", 10), ("2024-01-02", "2024-01-04", "2024-01-05", 3), ("2024-01-02", "2024-01-04", "2024-01-05", 10, 4)):
        with pytest.raises(ValueError):
            ingest.target_rows(rows, *args)


EVIDENCE = "instrument_id string, identifier string, start_date date, end_date date, state string"


def test_planned_segments(spark):
    aliases = spark.createDataFrame([("A", "AAA", day("2024-01-01"), day("2024-01-31")), ("B", "AAA", day("2024-01-29"), day("2024-02-09"))], ALIASES)
    rows = [
        ("A", "ticker:AAA", day("2024-01-01"), day("2024-01-05"), "validated"), ("A", "ticker:AAA", day("2024-01-08"), day("2024-01-12"), "validated"),  # only a weekend between
        ("A", "ticker:ZZZ", day("2024-01-15"), day("2024-01-17"), "validated"), ("A", "id:1", day("2024-01-18"), day("2024-01-24"), "validated"),
        ("C", "id:1", day("2024-01-23"), day("2024-03-01"), "validated"), ("A", "id:2", day("2024-01-25"), day("2024-01-26"), "rejected"), ("B", "id:3", day("2024-01-30"), day("2024-02-09"), "validated"),
    ]
    got = [tuple(r) for r in identity.plan_segments(aliases, spark.createDataFrame(rows, EVIDENCE), "2024-01-01", "2024-02-12").orderBy("first").collect()]
    assert got == [
        ("AAA", day("2024-01-01"), day("2024-01-12"), "ready", "A", "ticker:AAA"),
        ("AAA", day("2024-01-13"), day("2024-01-14"), "non_session_gap", "A", None),
        ("AAA", day("2024-01-15"), day("2024-01-17"), "identifier_alias_mismatch", "A", "ticker:ZZZ"),
        ("AAA", day("2024-01-18"), day("2024-01-22"), "ready", "A", "id:1"),
        ("AAA", day("2024-01-23"), day("2024-01-24"), "identifier_multiple_matches", "A", "id:1"),
        ("AAA", day("2024-01-25"), day("2024-01-28"), "identifier_zero_matches", "A", None),
        ("AAA", day("2024-01-29"), day("2024-01-31"), "alias_multiple", None, None),
        ("AAA", day("2024-02-01"), day("2024-02-09"), "ready", "B", "id:3"),
        ("AAA", day("2024-02-10"), day("2024-02-12"), "alias_zero", None, None),
    ]


def test_metadata_may_end_a_week_earlier(spark):
    schema = "ticker string, exchange string, start_date date, end_date date"
    archive = spark.createDataFrame([(t, "NYSE", day("2000-01-03"), day("2024-01-10")) for t in ("A", "B", "C", "D", "E")], schema)
    rows = [("a", "NYSE", day("2000-01-03"), day("2024-01-03")), ("B", "NYSE", day("2000-01-03"), day("2024-01-02")), ("C", "AMEX", day("2000-01-04"), day("2024-01-11")), ("D", "NYSE", day("2000-01-03"), None)]
    got = {r.ticker: r.mismatches for r in identity.metadata_agrees(archive, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"A": "", "B": "end_date", "C": "exchange,start_date,end_date", "D": "end_date", "E": "ticker,exchange,start_date,end_date"}


def test_two_pass_output(spark, tmp_path):
    score = "pair string, instrument_id string, events long, hits long, hit_rate double, shrunk_hit_rate double, lift double"
    candidates = spark.createDataFrame([("p", "A", 10, 6, 0.6, 0.55, 0.1, True), ("p", "B", 10, 1, 0.1, 0.2, -0.2, False)], score + ", selected boolean")
    evaluated = spark.createDataFrame([("p", "A", 4, 3, 0.75, 0.6, 0.2)], score)
    summary = spark.createDataFrame([("p", 40, 10, 1, 1, 1, 4, 3, 0.75, 0.25, 0.5)], "pair string, baseline_events long, baseline_hits long, candidates long, with_events long, above_baseline long, candidate_events long, candidate_hits long, candidate_hit_rate double, baseline_hit_rate double, lift double")
    paths = ranking.write_two_pass(f"{tmp_path}/out", candidates, evaluated, evaluated.limit(0))
    assert [p.removeprefix(f"{tmp_path}/out") for p in paths] == ["", "-candidates"] and spark.read.parquet(paths[1]).columns[0] == "window"
    text = ranking.render_two_pass(summary, candidates, evaluated, spark.createDataFrame([("A", "AAA")], "instrument_id string, ticker string"))
    assert text[1].startswith("pooled: candidates 75.0%, baseline 25.0%, lift 50.0%") and text[-1].split() == ["AAA", "10", "60.0%", "4", "75.0%", "60.0%", "20.0%"]


def test_findings_have_one_order(spark):
    rows = [("intraday_5min", "duplicate_keys", "A", "error", "m"), ("eod", "split_sanity", None, "error", "m"), ("eod", "duplicate_keys", "B", "error", "m"), ("eod", "duplicate_keys", "A", "error", "m")]
    got = quality.ordered_findings(spark.createDataFrame(rows, "dataset_key string, check string, instrument_id string, severity string, message string")).collect()
    assert [(r.dataset_key, r.check, r.instrument_id) for r in got] == [("eod", "duplicate_keys", "A"), ("eod", "duplicate_keys", "B"), ("eod", "split_sanity", None), ("intraday_5min", "duplicate_keys", "A")]


def test_exact_quantiles_equal_a_sort(spark):
    import random

    from barlake.operators import studies

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.001, rng.gauss(0, 0.05), -7.5])) for _ in range(4000)] + [("one", 0.5), ("two", 1.0), ("two", 2.0), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in studies.quantiles(df, ["k"], "x", studies.QUANTILES).collect()}
    assert set(got) == {"a", "b", None, "one", "two"}
    want = df.groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in studies.QUANTILES.items()]).filter("median_return IS NOT NULL")
    for r in want.collect():
        assert all(abs(got[r.k][n] - r[n]) < 1e-12 for n in studies.QUANTILES)
