from datetime import date, datetime

import pytest

from barlake.functions import calendar


def test_daylight_saving_moves_the_open():
    (friday,) = calendar.sessions(date(2024, 3, 8), date(2024, 3, 8))
    (monday,) = calendar.sessions(date(2024, 3, 11), date(2024, 3, 11))
    assert friday[1] == datetime(2024, 3, 8, 14, 30) and monday[1] == datetime(2024, 3, 11, 13, 30)


@pytest.mark.parametrize("day", ["2025-11-27", "2024-07-04", "2024-01-15", "2024-03-29", "2022-06-20", "2021-12-24", "2001-09-11", "2012-10-29", "2023-01-02", "1998-01-19", "2025-01-09"])
def test_holidays(day):
    assert not calendar.is_session(date.fromisoformat(day))


@pytest.mark.parametrize("day", ["2021-12-31", "1997-01-20", "2021-06-18", "2024-12-24", "2024-07-03"])
def test_sessions(day):
    assert calendar.is_session(date.fromisoformat(day))


def test_early_close_and_labels(spark):
    schedule = calendar.session_schedule(spark, date(2025, 11, 28), date(2025, 11, 28))
    row = schedule.first()
    assert row.session_close == datetime(2025, 11, 28, 18) and row.is_early_close
    assert calendar.expected_labels(schedule, "5min").count() == 42
    hours = [r.ts for r in calendar.expected_labels(calendar.session_schedule(spark, date(2024, 3, 11), date(2024, 3, 11)), "1hour").orderBy("ts").collect()]
    assert [h.hour for h in hours] == [14, 15, 16, 17, 18, 19]


@pytest.mark.parametrize("day,early", [
    ("1995-07-03", True), ("1996-07-03", False), ("1996-07-05", True), ("1997-12-26", True), ("1999-12-31", True), ("1999-12-30", False), ("2000-07-03", True), ("2002-07-03", False), ("2002-07-05", True),
    ("2003-12-26", True), ("2008-12-24", True), ("2012-07-03", True), ("2013-07-03", True), ("2019-07-03", True), ("2013-07-05", False), ("2018-12-24", True), ("2023-11-24", True), ("2022-12-23", False),
])
def test_early_closes_by_year(day, early):
    day = date.fromisoformat(day)
    assert calendar.is_session(day) and calendar.is_early_close(day) == early


def test_every_tabled_day_is_a_session():
    assert all(calendar.is_session(d) and d.year < calendar.EARLY_BY_RULE for d in calendar.EARLY)


def test_sessions_of_a_year():
    """Published numbers of trading days."""
    counts = {1995: 252, 1996: 254, 1997: 253, 1998: 252, 1999: 252, 2000: 252, 2001: 248, 2012: 250, 2018: 251, 2020: 253, 2021: 252, 2024: 252}
    assert {y: len(calendar.sessions(date(y, 1, 1), date(y, 12, 31))) for y in counts} == counts


def test_chunks_of_spans(spark):
    spans = spark.createDataFrame([("A", date(2023, 1, 1), date(2024, 12, 31)), ("B", date(2024, 1, 2), date(2024, 1, 2)), ("C", date(2024, 2, 2), date(2024, 1, 1))], "instrument_id string, start_date date, end_date date")
    rows = calendar.chunked(spans, "5min").collect()
    assert [(r.start, r.end) for r in rows if r.instrument_id == "A"] == [(c.start, c.end) for c in calendar.request_chunks(date(2023, 1, 1), date(2024, 12, 31), "5min")]
    assert [r.fetch_end for r in rows if r.instrument_id == "B"] == [date(2024, 1, 3)] and not [r for r in rows if r.instrument_id == "C"]


def test_next_and_latest_session():
    assert calendar.next_session_after(date(2024, 1, 1)) == date(2024, 1, 2)
    assert calendar.next_session_after(date(2022, 1, 2)) == date(2022, 1, 3)
    assert calendar.latest_completed_session(datetime(2024, 1, 16, 20, 59)) == date(2024, 1, 12)
    assert calendar.latest_completed_session(datetime(2024, 1, 16, 21, 0)) == date(2024, 1, 16)


def test_label_sessions_keeps_whole_regular_bars(spark):
    schedule = calendar.session_schedule(spark, date(2024, 1, 2), date(2024, 1, 3))
    times = ["2024-01-02 14:30", "2024-01-02 14:33", "2024-01-02 15:00", "2024-01-02 20:00", "2024-01-02 20:55", "2024-01-02 21:00", "2024-01-06 15:00"]
    bars = spark.createDataFrame([("A", datetime.fromisoformat(t), 1.0) for t in times], "instrument_id string, ts timestamp_ntz, close double")
    five = {str(r.ts)[11:16]: r.minutes_from_open for r in calendar.label_sessions(bars, schedule, "5min").collect()}
    assert five == {"14:30": 0, "15:00": 30, "20:00": 330, "20:55": 385}
    assert [str(r.ts)[11:16] for r in calendar.label_sessions(bars, schedule, "1hour").orderBy("ts").collect()] == ["15:00", "20:00"]
    with pytest.raises(ValueError):
        calendar.label_sessions(bars.withColumn("session_date", bars.ts), schedule, "5min")
