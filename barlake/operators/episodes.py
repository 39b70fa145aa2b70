"""Listing episodes: one sweep over an instrument's days that cuts it where one listing ends and another begins.

A boundary is a hole of many missing sessions, or a bridge: a long run of sessions without volume between
traded ones. Invalid bars and the bars of bridges are set aside, and so are parts too short to be a
listing of their own. Where two or more parts remain, each becomes an instrument with an identity that
follows from its source, ticker, first day and place (UUID version 5), so that a repeated repair gives
the same ids; a repaired instrument has no boundary left.

All windows are over one instrument: one exchange, and a sort for each order that they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import exprs

# The namespace of URLs in RFC 9562, and the prefix of the names of episodes.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
FEWEST = 20  # clean bars of a listing
ANCHOR = "market-data-eod-episode-v1"
INVALID, BRIDGE, SHORT = "ohlc_invariants", "zero_volume_episode_bridge", "short_inferred_episode"


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name within the namespace of URLs, as 32 hexadecimal digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def assigned(bars: DataFrame, sources: DataFrame, indexed: DataFrame, longest: int, fewest: int = FEWEST, bridge: int | None = None, partitions: int | None = None) -> DataFrame:
    """Every bar with its episode: columns of ``bars`` and part, boundary, quarantine_reason, ordinal, episodes, episode_id, part_first, part_last.

    ``sources`` is (instrument_id, ticker, start_date, end_date), one row for each instrument that may be cut;
    bars of others pass unchanged (part 0, no reason). ``longest`` sessions without a bar, or ``bridge`` (or else
    ``longest``) without volume between traded sessions, are a boundary; it stands on the first bar after it.
    ``part`` counts boundaries up to a bar. A bar off the calendar makes no boundary and breaks no run. Invalid
    bars of every source are set aside. Where there is a boundary, parts of fewer than ``fewest`` clean bars are
    too; with fewer than two others the instrument keeps its id (``episode_id`` is its own). The sorts of all
    windows are in one task's memory: ``partitions`` says how many tasks share the bars, else the session does.
    """
    s = sources.select("instrument_id", "ticker", F.col("start_date").alias("alias_start"), F.col("end_date").alias("alias_end"), F.lit(True).alias("known"))
    calendar = F.broadcast(indexed.select(F.col("session_date").alias("date"), F.col("session_index").alias("_at")))
    rows = bars.repartition(*filter(None, [partitions]), "instrument_id").join(s, "instrument_id", "left").join(calendar, "date", "left").withColumn("_on", F.col("_at").isNotNull() & F.col("known"))

    # Bars on the calendar only, from the last day back: the next day with volume.
    back = Window.partitionBy("instrument_id", "_on").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_next", F.min(F.when(F.col("volume") != 0, F.col("date"))).over(back))
    forth = Window.partitionBy("instrument_id", "_on").orderBy("date")
    upto = forth.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.coalesce(F.col("volume") == 0, F.lit(False))
    rows = rows.withColumns({"_run": F.sum((~zero).cast("int")).over(upto), "_hole": F.col("_at") - F.lag("_at").over(forth) - 1})
    run = Window.partitionBy("instrument_id", "_on", "_run")
    # A run's number is that of bars with volume before it; without any, it opens the history and bridges nothing.
    long = zero & F.col("_on") & (F.col("_run") > 0) & (F.sum(zero.cast("int")).over(run) >= (bridge or longest)) & F.col("_next").isNotNull()
    rows = rows.withColumn("_bridge", long)

    line = Window.partitionBy("instrument_id").orderBy("date")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after_bridge = F.coalesce(F.max(F.when(F.col("_bridge"), F.col("_next"))).over(before) == F.col("date"), F.lit(False)) & F.col("_on")
    after_hole = F.coalesce(F.col("_hole") >= longest, F.lit(False)) & F.col("_on")
    boundary = F.when(after_hole & after_bridge, "missing_sessions,zero_volume_bridge").when(after_hole, "missing_sessions").when(after_bridge, "zero_volume_bridge")
    rows = rows.withColumn("boundary", boundary).withColumn("part", F.sum(F.col("boundary").isNotNull().cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))

    invalid = F.coalesce(exprs.ohlc_invalid(), F.lit(True)) & F.coalesce("known", F.lit(False))
    rows = rows.withColumn("_clean", ~invalid & ~F.col("_bridge"))
    part = Window.partitionBy("instrument_id", "part")
    clean_day = F.when(F.col("_clean"), F.col("date"))
    rows = rows.withColumns({"_n": F.sum(F.col("_clean").cast("int")).over(part), "part_first": F.min(clean_day).over(part), "part_last": F.max(clean_day).over(part)})
    cut = F.max("part").over(Window.partitionBy("instrument_id")) > 0
    rows = rows.withColumn("_cut", cut)
    enough = (F.col("_n") >= fewest) | ~F.col("_cut")
    opens = (enough & F.col("_clean") & (F.col("date") == F.col("part_first"))).cast("int")
    # A day may hold several rows: a part opens once.
    twice = F.lag("date").over(line) == F.col("date")
    rows = rows.withColumn("_opens", F.when(F.coalesce(twice, F.lit(False)) & (F.lag(opens).over(line) == 1), 0).otherwise(opens))
    rows = rows.withColumns({"ordinal": F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)), "episodes": F.sum("_opens").over(Window.partitionBy("instrument_id"))})
    reason = (
        F.when(F.coalesce("known", F.lit(False)) == F.lit(False), None).when(invalid, INVALID).when(F.col("_bridge"), BRIDGE).when(~enough, SHORT)
    )
    split = (F.col("episodes") > 1) & reason.isNull() & F.col("known")
    start = F.when(F.col("ordinal") == 1, F.col("alias_start")).otherwise(F.col("part_first"))
    anchor = F.concat_ws("|", F.lit(ANCHOR), "instrument_id", "ticker", start.cast("string"), F.col("ordinal").cast("string"))
    rows = rows.withColumns({"quarantine_reason": reason, "episode_id": F.when(reason.isNull(), F.when(split, uuid5(anchor)).otherwise(F.col("instrument_id")))})
    made = ["part", "boundary", "quarantine_reason", "ordinal", "episodes", "episode_id", "part_first", "part_last", "ticker", "alias_start", "alias_end"]
    return rows.select(*bars.columns, *made)


def plan(rows: DataFrame) -> DataFrame:
    """The new instruments of ``assigned`` bars: source, place, id, label, alias span, and the days and number of their bars."""
    kept = rows.filter("quarantine_reason IS NULL AND episode_id <> instrument_id")
    parts = kept.groupBy(F.col("instrument_id").alias("source_id"), "ticker", "ordinal", "episodes", "episode_id", "part_first", "part_last", "alias_start", "alias_end").agg(F.count("*").alias("n_bars"))
    start = F.when(F.col("ordinal") == 1, F.col("alias_start")).otherwise(F.col("part_first"))
    end = F.when(F.col("ordinal") == F.col("episodes"), F.col("alias_end")).otherwise(F.col("part_last"))
    return parts.select(
        "source_id", "ordinal", F.col("episode_id").alias("instrument_id"), F.concat("ticker", F.lit("@"), F.date_format(start, "yyyyMMdd")).alias("display_label"),
        start.alias("start_date"), end.alias("end_date"), F.col("part_first").alias("observed_first"), F.col("part_last").alias("observed_last"), "n_bars", "ticker",
    )


def quarantined(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The bars that are set aside, with the reason."""
    return rows.filter("quarantine_reason IS NOT NULL").select(*columns, "quarantine_reason")


def repaired(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The bars that stay, under the ids of their episodes."""
    return rows.filter("quarantine_reason IS NULL").select(*[F.col("episode_id").alias("instrument_id") if c == "instrument_id" else F.col(c) for c in columns])


def repaired_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Sources after a repair: each episode in place of the instrument it comes from."""
    kept = sources.join(found.select(F.col("source_id").alias("instrument_id")).distinct(), "instrument_id", "left_anti")
    return kept.select("instrument_id", "ticker", "start_date", "end_date").unionByName(found.select("instrument_id", "ticker", "start_date", "end_date"))
