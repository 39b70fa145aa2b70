"""Health of the collection: each check gives one row (check, severity, affected, total, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.quality import SAMPLE

# Statuses of a target's last attempt, and what a warning and an error begin at.
PENDING, EXHAUSTED = "current_retry_pending", "current_retry_exhausted"
RATE_WARNING, STALE_ERROR, STUCK_ERROR = 0.8, 0.25, 0.1
TOP_RANKS, STUCK_TURNS = 100, 5


def _finding(check: str, severity: Column, affected: Column, total: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), severity.alias("severity"), affected.cast("long").alias("affected"), total.cast("long").alias("total"), detail.alias("detail")]


def request_rate(usage: DataFrame, hourly_limit: int, daily_limit: int) -> DataFrame:
    """The worse of the hour's and the day's share of the limits, from a row of ``ledger_usage``."""
    hourly, daily = F.col("hourly_requests") / hourly_limit, F.col("daily_requests") / daily_limit
    worst = F.greatest(hourly, daily)
    severity = F.when(worst >= 1, "error").when(worst >= RATE_WARNING, "warning").otherwise("ok")
    return usage.select(*_finding("request_rate", severity, F.col("daily_requests"), F.lit(daily_limit), F.concat(F.col("hourly_requests").cast("string"), F.lit("/"), F.lit(hourly_limit))))


def coverage_freshness(cohort: DataFrame, coverage: DataFrame, target: str, top_ranks: int = TOP_RANKS) -> DataFrame:
    """Members (instrument_id, rank) whose coverage ends before the target session, or that have none.

    An error where one of the top ranks is among them, or a quarter of all members.
    """
    rows = cohort.select("instrument_id", "rank").join(coverage.select("instrument_id", "last_date"), "instrument_id", "left")
    stale = F.coalesce(F.col("last_date") < F.lit(target).cast("date"), F.lit(True))
    held = rows.agg(F.count("*").alias("members"), F.count_if(stale).alias("stale"), F.count_if(stale & (F.col("rank") <= top_ranks)).alias("top")).filter("members > 0")
    severity = F.when(F.col("stale") == 0, "ok").when((F.col("top") > 0) | (F.col("stale") / F.col("members") >= STALE_ERROR), "error").otherwise("warning")
    return held.select(*_finding("coverage_freshness", severity, F.col("stale"), F.col("members"), F.concat(F.lit("top "), F.col("top").cast("string"))))


def retry_progress(targets: DataFrame, stuck_turns: int = STUCK_TURNS) -> DataFrame:
    """Targets (last_status, successful_depth, attempted_turns) that retry without advance, or gave up."""
    stuck = (F.col("last_status") == PENDING) & (F.col("successful_depth") == 0) & (F.col("attempted_turns") >= stuck_turns)
    gone = F.coalesce(F.col("last_status") == EXHAUSTED, F.lit(False))
    held = targets.agg(F.count("*").alias("total"), F.count_if(stuck).alias("stuck"), F.count_if(gone).alias("exhausted")).filter("stuck + exhausted > 0")
    bad = F.col("stuck") + F.col("exhausted")
    severity = F.when(bad / F.col("total") >= STUCK_ERROR, "error").otherwise("warning")
    return held.select(*_finding("ongoing_progress", severity, bad, F.col("total"), F.concat_ws(" ", F.col("stuck").cast("string"), F.lit("stuck"), F.col("exhausted").cast("string"), F.lit("exhausted"))))


def only_retries_left(ranges: DataFrame) -> DataFrame:
    """Whether some active range is left and every one belongs to a target that waits for its retry."""
    live = ranges.filter((F.col("status") == "active") & ~F.col("terminal_blocked"))
    other = F.count_if(~F.coalesce(F.col("last_status") == PENDING, F.lit(False)))
    return live.agg(F.count("*").alias("active"), other.alias("other")).select("active", ((F.col("active") > 0) & (F.col("other") == 0)).alias("only_retries"))


def exclusions(blocked: DataFrame) -> DataFrame:
    """Targets (ticker, status) left out before any request, a warning by status."""
    per = blocked.groupBy("status").agg(F.count("*").alias("n"))
    return per.select(*_finding("ongoing_exclusions", F.lit("warning"), F.col("n"), F.sum("n").over(_whole()), F.col("status")))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # a handful of statuses


def unresolved_listings(listings: DataFrame, unique: DataFrame) -> DataFrame:
    """Active listings whose ticker does not name exactly one instrument."""
    rows = listings.select("ticker").distinct().join(unique.select("ticker", F.lit(1).alias("known")).distinct(), "ticker", "left")
    lost = F.col("known").isNull()
    some = rows.filter(lost).orderBy("ticker").limit(SAMPLE).agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("sample"))
    held = rows.agg(F.count("*").alias("total"), F.count_if(lost).alias("n")).filter("total > 0").crossJoin(some)  # a row each
    return held.select(*_finding("unresolved_listings", F.when(F.col("n") > 0, "warning").otherwise("ok"), F.col("n"), F.col("total"), F.col("sample")))
