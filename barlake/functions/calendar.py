"""Sessions of the New York exchange from its holiday rules, as plain values and as frames."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import exprs

ZONE = ZoneInfo(exprs.NEW_YORK)
FULL_SESSION_BARS = {"1hour": 6, "5min": 78}
BAR_MINUTES = {"1hour": 60, "5min": 5}
ROW_CAP = 10_000
NOT_BEFORE = time(23, 30)
SEMANTICS = {"1hour": "eastern_clock_hour_start", "5min": "session_5min_start"}

# Days the exchange was closed outside its yearly rules.
CLOSED = frozenset(
    date(*d) for d in [(1994, 4, 27), (2001, 9, 11), (2001, 9, 12), (2001, 9, 13), (2001, 9, 14), (2004, 6, 11), (2007, 1, 2), (2012, 10, 29), (2012, 10, 30), (2018, 12, 5), (2025, 1, 9)]
)
# Days that closed at 13:00 in the years when practice varied.
EARLY = frozenset(
    date.fromisoformat(d) for d in """
    1993-11-26 1994-11-25 1995-07-03 1995-11-24 1996-07-05 1996-11-29 1996-12-24 1997-07-03 1997-11-28 1997-12-24 1997-12-26 1998-11-27 1998-12-24
    1999-11-26 1999-12-31 2000-07-03 2000-11-24 2001-07-03 2001-11-23 2001-12-24 2002-07-05 2002-11-29 2002-12-24 2003-07-03 2003-11-28 2003-12-24 2003-12-26
    2004-11-26 2005-11-25 2006-07-03 2006-11-24 2007-07-03 2007-11-23 2007-12-24 2008-07-03 2008-11-28 2008-12-24 2009-11-27 2009-12-24
    2010-11-26 2011-11-25 2012-07-03 2012-11-23 2012-12-24
    """.split()
)
EARLY_BY_RULE = 2013  # the first year that follows the rule
SCHEDULE = "session_date date, session_open timestamp_ntz, session_close timestamp_ntz, is_early_close boolean"


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> date:
    """Gregorian Easter by the anonymous computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def _observed(day: date) -> date:
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


@lru_cache(maxsize=None)
def holidays(year: int) -> frozenset[date]:
    new_year = date(year, 1, 1)
    out = {
        _nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)),
        _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25)),
    }
    if new_year.weekday() != 5:  # on a Saturday it is not observed
        out.add(_observed(new_year))
    if year >= 1998:
        out.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return frozenset(out) | {d for d in CLOSED if d.year == year}


def is_session(day: date) -> bool:
    return day.weekday() < 5 and day not in holidays(day.year)


def is_early_close(day: date) -> bool:
    """Whether a session closes at 13:00: a table up to 2012, none before 1993.

    From 2013 on these are the day after Thanksgiving, and July 3 and December 24 where they are sessions.
    """
    if day.year < EARLY_BY_RULE:
        return day in EARLY
    return is_session(day) and (day == _nth(day.year, 11, 3, 4) + timedelta(1) or (day.month, day.day) in ((7, 3), (12, 24)))


def _utc(day: date, at: time) -> datetime:
    return datetime.combine(day, at, ZONE).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


@lru_cache(maxsize=64)
def sessions(start: date, end: date) -> tuple[tuple[date, datetime, datetime, bool], ...]:
    """(day, open, close, early) of every session in the closed range, times in UTC."""
    out = []
    for n in range((end - start).days + 1):
        day = start + timedelta(n)
        if is_session(day):
            early = is_early_close(day)
            out.append((day, _utc(day, time(9, 30)), _utc(day, time(13 if early else 16)), early))
    return tuple(out)


def next_session_after(day: date) -> date:
    found = sessions(day, day + timedelta(15))
    return found[bisect_right([s[0] for s in found], day)][0]


def latest_completed_session(now: datetime) -> date:
    """The last session that closed by the given UTC time, within ten days."""
    day = now.date()
    return max(s[0] for s in sessions(day - timedelta(10), day) if s[2] <= now)


@dataclass(frozen=True)
class CollectionWindow:
    session_date: date
    opens_at: datetime
    closes_at: datetime


def overnight_window(now: datetime, morning_hour: int = 8) -> CollectionWindow | None:
    """The window after the last closed session in which ``now`` (UTC, no zone) lies, or None.

    It opens at the close, though not before 23:30 UTC of the session's day, and ends at
    ``morning_hour`` New York time of the next session's day: a weekend is one long night.
    """
    if not 0 <= morning_hour <= 23:
        raise ValueError("the morning hour lies in 0..23")
    day = latest_completed_session(now)
    opens = max(sessions(day, day)[0][2], datetime.combine(day, NOT_BEFORE))
    closes = _utc(next_session_after(day), time(morning_hour))
    return CollectionWindow(day, opens, closes) if opens <= now < closes else None


@dataclass(frozen=True)
class RequestChunk:
    start: date
    end: date
    fetch_end: date
    max_rows: int


def weekday_count(start: date, end: date) -> int:
    """Days from Monday to Friday in the closed range."""
    days = (end - start).days + 1
    weeks, rest = divmod(max(days, 0), 7)
    return weeks * 5 + sum((start.weekday() + i) % 7 < 5 for i in range(rest))


def probe_sessions(freq: str) -> int:
    """The most sessions one request can hold beside the day it looks ahead."""
    return (ROW_CAP - 1) // FULL_SESSION_BARS[freq] - 1


def request_chunks(start: date, end: date, freq: str, reverse: bool = False) -> list[RequestChunk]:
    """Cut [start, end] into requests below the row cap, each fetched through the session after its end.

    Every weekday may have a full session's bars. A chunk ends on the last day whose next session still
    fits; that day moves with the number of weekdays, so it is found from their count.
    """
    if start > end:
        raise ValueError("the start lies after the end")
    most = (ROW_CAP - 1) // FULL_SESSION_BARS[freq]
    out = []
    while start <= end:
        fits = lambda day: weekday_count(start, next_session_after(day)) <= most  # noqa: B023, E731
        if not fits(start):
            raise ValueError("one day does not fit below the row cap")
        # So many weekdays span at most this many days; from there back to a day that fits.
        day = min(end, start + timedelta(most // 5 * 7 + 7))
        while not fits(day):
            day -= timedelta(1)
        ahead = next_session_after(day)
        out.append(RequestChunk(start, day, ahead, weekday_count(start, ahead) * FULL_SESSION_BARS[freq]))
        start = day + timedelta(1)
    return out[::-1] if reverse else out


def chunked(spans: DataFrame, freq: str) -> DataFrame:
    """(instrument_id, start, end, fetch_end, max_rows): the requests that cover each (instrument_id, start_date, end_date)."""

    def cut(batches):
        for batch in batches:
            parts = [(i, c) for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for c in request_chunks(a, b, freq)]
            columns = [[i for i, _ in parts], *([getattr(c, k) for _, c in parts] for k in ("start", "end", "fetch_end", "max_rows"))]
            kinds = [pa.string(), pa.date32(), pa.date32(), pa.date32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["instrument_id", "start", "end", "fetch_end", "max_rows"])

    return spans.select("instrument_id", "start_date", "end_date").filter("start_date <= end_date").mapInArrow(cut, "instrument_id string, start date, end date, fetch_end date, max_rows long")


def session_schedule(spark: SparkSession, start: date, end: date) -> DataFrame:
    """The schedule as a frame; a few hundred rows a year, so joins broadcast it."""
    return spark.createDataFrame(list(sessions(start, end)), SCHEDULE)


def next_sessions(days: DataFrame, schedule: DataFrame) -> DataFrame:
    """(date, next_session) of each date before the schedule's last session: the first session after it.

    Each session stands for the days from the session before it on, so that the join is an equality.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.lag("session_date").over(Window.orderBy("session_date")), F.date_sub("session_date", 366))
    after = schedule.select("session_date", before.alias("before")).select(F.explode(F.sequence("before", F.date_sub("session_date", 1))).alias("date"), F.col("session_date").alias("next_session"))
    return days.join(F.broadcast(after), "date").select("date", "next_session")


def with_index(schedule: DataFrame) -> DataFrame:
    """Number sessions from 0 in order; dates are few, so the ranking is one small task."""
    from pyspark.sql import Window

    return schedule.withColumn("session_index", (F.row_number().over(Window.orderBy("session_date")) - 1).cast("int"))


def sessions_upto(schedule: DataFrame) -> DataFrame:
    """(day, upto, is_session) for every day from a year before the schedule to a year after it: sessions up to the day."""
    from pyspark.sql import Window

    span = schedule.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", 366), F.date_add("b", 366))).alias("day"))
    marked = days.join(schedule.select(F.col("session_date").alias("day"), F.lit(True).alias("is_session")), "day", "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))
    return marked.withColumn("upto", F.sum(F.col("is_session").cast("int")).over(Window.orderBy("day")))


def expected_labels(schedule: DataFrame, freq: str) -> DataFrame:
    """(ts, session_date) of every regular bar: clock hours from 10:00, or five minutes from the open."""
    step = BAR_MINUTES[freq]
    first = exprs.ny_to_utc(F.col("session_date"), 10) if freq == "1hour" else F.col("session_open")
    last = F.col("session_close") - F.expr(f"INTERVAL {step} MINUTE")
    return schedule.select("session_date", F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step} MINUTE"))).alias("ts")).select("ts", "session_date")


def label_sessions(bars: DataFrame, schedule: DataFrame, freq: str) -> DataFrame:
    """Bars that lie whole in their session, with its columns; others go. UTC dates join sessions."""
    clash = {"session_date", "session_open", "session_close", "is_early_close", "minutes_from_open", "bar_label_semantics"} & set(bars.columns)
    if clash:
        raise ValueError(f"bars already have {sorted(clash)}")
    joined = bars.join(F.broadcast(schedule), exprs.utc_date(F.col("ts")) == schedule.session_date)
    return joined.filter(aligned(freq)).withColumn("minutes_from_open", exprs.minutes_between(F.col("session_open"), F.col("ts"))).withColumn("bar_label_semantics", F.lit(SEMANTICS[freq]))


def aligned(freq: str) -> Column:
    """Whether a bar joined to its session starts where a regular bar does and ends by the close."""
    ts, start, close = F.col("ts"), F.col("session_open"), F.col("session_close")
    within = (ts >= start) & (ts + F.expr(f"INTERVAL {BAR_MINUTES[freq]} MINUTE") <= close)
    local = exprs.ny(ts)
    if freq == "1hour":
        return within & (F.minute(local) == 0) & (F.second(local) == 0) & (F.hour(local) >= 10)
    return within & (exprs.minutes_between(start, ts) % 5 == 0) & (F.second(local) == 0)
