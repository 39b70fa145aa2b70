"""Column helpers. Timestamps are zone-less and mean UTC, so no result depends on the session's zone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def ratio_minus_one(n: Column, d: Column) -> Column:
    """n / d - 1 where d is known and positive, else null."""
    return F.when(d.isNotNull() & (d > 0), n / d - 1)


def ratio(n: Column, d: Column) -> Column:
    """n / d where d isn't zero, else null."""
    return F.when(d != 0, n / d)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ohlc_invalid(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    """Any price unknown or not finite, or a high or low that the other prices contradict."""
    prices = [F.col(x) for x in (o, h, lo, c)]
    unknown = F.lit(False)
    for p in prices:
        unknown = unknown | p.isNull() | ~is_finite(p.cast("double"))
    o_, h_, l_, c_ = prices
    return F.coalesce(unknown | (h_ < F.greatest(o_, l_, c_)) | (l_ > F.least(o_, h_, c_)), F.lit(True))


def valid_ordering(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    """The looser check of outcome bars: ordered prices and a positive close."""
    return (F.col(h) >= F.greatest(o, c)) & (F.col(lo) <= F.least(o, c)) & (F.col(c) > 0)


def corporate_action(div: str = "div_cash", split: str = "split_factor") -> Column:
    return (F.coalesce(F.col(div), F.lit(0.0)) > 0) | (F.coalesce(F.col(split), F.lit(1.0)) != 1)


def ny(ts: Column) -> Column:
    """New York wall time of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), ts)


def ny_date(ts: Column) -> Column:
    return ny(ts).cast("date")


def utc_date(ts: Column) -> Column:
    return ts.cast("date")


def ny_to_utc(day: Column, hour: int) -> Column:
    """The UTC time of an hour of a New York day."""
    return F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), day.cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOUR"))


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes elapsed from a to b."""
    return F.timestamp_diff("MINUTE", a, b).cast("int")


def bucket(column: str = "instrument_id") -> Column:
    """Storage bucket: the first byte of the id's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 2)


def period_label(day: Column, periods: Mapping[str, tuple[date, date]]) -> Column:
    """The first period whose closed range holds the day, else "unassigned"."""
    out = F.lit("unassigned")
    for name, (start, end) in reversed(list(periods.items())):
        out = F.when(day.between(F.lit(start), F.lit(end)), F.lit(name)).otherwise(out)
    return out


def market_regime(vol: Column, stress: float) -> Column:
    return F.when(vol.isNull(), "unknown").when(vol >= stress, "stress").otherwise("calm")


def market_trend(ret: Column) -> Column:
    return F.when(ret.isNull(), "unknown").when(ret < 0, "down").otherwise("up")


def liquidity(adv: Column, large: float, middle: float) -> Column:
    return F.when(adv >= large, "large").when(adv >= middle, "middle").otherwise("small")


def hour_label(hour: Column) -> Column:
    """Label of an hourly checkpoint: when it is known, and the bar it closes."""
    return F.format_string("%02d:00_close_of_%02d:00_bar", hour + 1, hour)


def minute_label(minutes: Column) -> Column:
    """Label of a checkpoint some minutes after a 09:30 open: the time the bar ends."""
    end = F.lit(570) + minutes
    return F.format_string("%02d:%02d_close_of_5min_bar", F.floor(end / 60).cast("int"), end % 60)


def rounded(columns: Sequence[str], digits: int = 6) -> dict[str, Column]:
    return {c: F.round(F.col(c), digits) for c in columns}
