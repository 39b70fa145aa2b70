"""Causal features: every window ends at the row before the decision session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import calendar, exprs


def eod_features(bars: DataFrame, lookback: int) -> DataFrame:
    """Decision features of each daily bar from the ``lookback`` rows before it, its own open aside.

    All windows share one partitioning and order, so the plan has one exchange and one sort.
    """
    if lookback < 2:
        raise ValueError("the lookback needs at least two sessions")
    w = Window.partitionBy("instrument_id").orderBy("date")
    prior = w.rowsBetween(-lookback, -1)
    back = F.lag("adj_close").over(w)
    rows = bars.withColumns(
        {
            "prior_date": F.lag("date").over(w),
            "prior_close_raw": F.lag("close").over(w),
            "prior_adj_close": back,
            "adj_close_6_back": F.lag("adj_close", 6).over(w),
            "window_back": F.lag("adj_close", lookback).over(w),
            "lookback_start_date": F.lag("date", lookback).over(w),
            "prior_sessions_present": F.count("*").over(prior),
            "adv_dollars": F.avg(F.when(F.col("volume") >= 0, F.col("close") * F.col("volume"))).over(prior),
            "log_return": F.when((F.col("adj_close") > 0) & (back > 0), F.ln(F.col("adj_close") / back)),
        }
    ).withColumn("realized_vol", F.stddev_samp("log_return").over(prior))
    gap = exprs.ratio_minus_one(F.col("adj_open"), F.col("prior_adj_close"))
    return rows.select(
        "instrument_id", "date", F.col("open").alias("open_raw"), "adj_open", "prior_date", "prior_close_raw", "prior_adj_close", "lookback_start_date",
        "prior_sessions_present", "adv_dollars", "realized_vol", "adj_close_6_back",
        exprs.ratio_minus_one(F.col("prior_adj_close"), F.col("adj_close_6_back")).alias("prior_5_return"),
        exprs.ratio_minus_one(F.col("prior_adj_close"), F.col("window_back")).alias("prior_window_return"),
        gap.alias("gap_return"), F.when(F.col("realized_vol") > 0, gap / F.col("realized_vol")).alias("gap_vol_normalized"),
        exprs.corporate_action().alias("event_day_corporate_action"),
    )


def density(eod: DataFrame, bars: DataFrame, labels: DataFrame, freq: str, lookback: int) -> DataFrame:
    """Share of the expected bars of the prior sessions that traded; sessions without bars count 0."""
    labels = F.broadcast(labels)
    expected = labels.groupBy("session_date").agg(F.count("*").alias("expected_bars"))
    traded = bars.join(labels, "ts").groupBy("instrument_id", "session_date").agg(F.count_if(F.col("volume") > 0).alias("traded_bars"))
    days = (
        eod.select("instrument_id", "date")
        .join(traded.withColumnRenamed("session_date", "date"), ["instrument_id", "date"], "left")
        .join(F.broadcast(expected.withColumnRenamed("session_date", "date")), "date", "left")
        .withColumns({"traded_bars": F.coalesce("traded_bars", F.lit(0)), "expected_bars": F.coalesce("expected_bars", F.lit(calendar.FULL_SESSION_BARS[freq]))})
    )
    prior = Window.partitionBy("instrument_id").orderBy("date").rowsBetween(-lookback, -1)
    sums = days.select("instrument_id", "date", F.sum("traded_bars").over(prior).alias("prior_traded_bars"), F.sum("expected_bars").over(prior).alias("prior_expected_bars"))
    share = F.when(F.col("prior_expected_bars") > 0, F.col("prior_traded_bars") / F.col("prior_expected_bars"))
    return sums.withColumn("hourly_density" if freq == "1hour" else "five_min_density", share)


def hourly_density(eod: DataFrame, hourly: DataFrame, schedule: DataFrame, lookback: int) -> DataFrame:
    """``density`` of the hourly bars, whose expected labels follow from the schedule."""
    return density(eod, hourly, calendar.expected_labels(schedule, "1hour"), "1hour", lookback)
