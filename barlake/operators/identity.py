"""Alias resolution and interval algebra over closed date ranges; ambiguity is never guessed away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alias_asof(bars: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each bar with the one ticker its instrument had that day, else null; bars never multiply.

    A sweep over the spans' ends gives the segments with one ticker, which stand as marks among their
    instrument's bars: no span is exploded to days, and a bar moves once.
    """
    spans = aliases.filter("instrument_id IS NOT NULL AND ticker IS NOT NULL AND start_date <= end_date").select("instrument_id", "ticker", "start_date", "end_date")
    names = spans.select("instrument_id", "ticker").distinct().withColumn("number", F.row_number().over(Window.partitionBy("instrument_id").orderBy("ticker")))
    merged = merge_ranges(spans, ["instrument_id", "ticker"]).join(names, ["instrument_id", "ticker"]).withColumn("n", F.lit(1))
    # Where one ticker holds, the sum of the tickers' numbers is its number.
    alone = _running(_changes(merged, ["instrument_id"], ["n", "number"]), ["instrument_id"], ["n", "number"]).filter("n = 1")
    own = alone.join(names, ["instrument_id", "number"]).select("instrument_id", F.col("first").alias("date"), F.struct("first", "last", "ticker").alias("_held"))
    marks = own.select(*[c if c in ("instrument_id", "date") else F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in bars.columns], "_held")
    rows = bars.withColumn("_held", F.lit(None).cast(own.schema["_held"].dataType)).withColumn("_bar", F.lit(True)).unionByName(marks.withColumn("_bar", F.lit(False)))
    # All of a day's rows see the segment that begins on it.
    upto = Window.partitionBy("instrument_id").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_held", F.max("_held").over(upto)).filter("_bar")
    return rows.select(*bars.columns, F.when(F.col("date") <= F.col("_held.last"), F.col("_held.ticker")).alias("ticker"))


def _running(events: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, first, last, sums): between two changes the running sums of what began and ended before.

    One sort by the keys and the day, whatever the number of spans; ``last`` is null after the last change.
    """
    at = events.groupBy(*keys, "first").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*keys).orderBy("first")
    return at.select(*keys, "first", F.date_sub(F.lead("first").over(w), 1).alias("last"), *[F.sum(c).over(w).alias(c) for c in sums])


def _changes(spans: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """A row where a span begins, with its values, and one after its end, with their negatives."""
    begin = spans.select(*keys, F.col("start_date").alias("first"), *sums)
    return begin.union(spans.select(*keys, F.date_add("end_date", 1).alias("first"), *[(-F.col(c)).alias(c) for c in sums]))


def alias_segments(aliases: DataFrame, start: str, end: str) -> DataFrame:
    """Cut [start, end] for each ticker where a span begins or ends: (ticker, first, last, status, owner).

    A segment's status is resolved with one owner, zero or multiple otherwise. Owners are counted by a
    sweep: an owner's overlapping spans are joined, so that it counts once, and the sum of the owners'
    numbers within the ticker is the one owner's number where there is one.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    spans = aliases.filter((F.col("start_date") <= hi) & (F.col("end_date") >= lo))
    spans = spans.select("ticker", "instrument_id", F.greatest("start_date", lo).alias("start_date"), F.least("end_date", hi).alias("end_date"))
    owners = spans.select("ticker", "instrument_id").distinct().withColumn("number", F.row_number().over(Window.partitionBy("ticker").orderBy("instrument_id")))
    merged = merge_ranges(spans, ["ticker", "instrument_id"]).join(owners, ["ticker", "instrument_id"]).withColumn("n", F.lit(1))
    changes = _changes(merged, ["ticker"], ["n", "number"])
    # Every span's own ends cut, also where the owner stays; and the first day does.
    zero = [F.lit(0).alias("n"), F.lit(0).alias("number")]
    cuts = spans.select("ticker", F.explode(F.array("start_date", F.date_add("end_date", 1), lo)).alias("first"), *zero)
    parts = _running(changes.union(cuts), ["ticker"], ["n", "number"]).filter(F.col("first") <= hi)
    n = F.col("n")
    status = F.when(n == 1, "resolved").when(n == 0, "zero").otherwise("multiple")
    named = parts.join(owners.withColumnRenamed("instrument_id", "owner"), ["ticker", "number"], "left")
    return named.select("ticker", "first", F.least(F.coalesce("last", hi), hi).alias("last"), status.alias("status"), F.when(n == 1, F.col("owner")).alias("owner"))


def identifier_segments(evidence: DataFrame) -> DataFrame:
    """Cut each instrument's evidence spans where they change: agreed, rejected, unverified or conflict."""
    state = F.col("state")
    spans = evidence.select("instrument_id", "start_date", "end_date", F.lit(1).alias("n"), (state == "validated").cast("int").alias("yes"), (state == "rejected").cast("int").alias("no"))
    parts = _running(_changes(spans, ["instrument_id"], ["n", "yes", "no"]), ["instrument_id"], ["n", "yes", "no"]).filter("n > 0")
    status = F.when((F.col("yes") > 0) & (F.col("no") > 0), "conflict").when(F.col("yes") > 0, "validated").when(F.col("no") > 0, "rejected").otherwise("unverified")
    return parts.select("instrument_id", "first", "last", status.alias("status"))


def identifier_ranges(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut each span where validated evidence changes: its columns with (first, last, status, identifier).

    ``spans`` is (instrument_id, start_date, end_date). Boundaries are those of the instrument's own
    evidence and of other instruments' for the same identifiers. A part is resolved where exactly one
    identifier covers it that no other instrument holds then, multiple_matches where several do or
    another holds it, zero_matches otherwise. Parts lie between two changes, so that a span covers a
    part or does not touch it.
    """
    valid = evidence.filter("state = 'validated'").select("instrument_id", "identifier", "start_date", "end_date").distinct()
    wanted = spans.select("instrument_id", F.col("start_date").alias("span_start"), F.col("end_date").alias("span_end"))
    own = wanted.join(valid, "instrument_id").filter((F.col("start_date") <= F.col("span_end")) & (F.col("end_date") >= F.col("span_start")))
    keys = own.select("instrument_id", "span_start", "span_end", "identifier").distinct()
    other = valid.withColumnRenamed("instrument_id", "holder")
    rival = keys.join(other, "identifier").filter((F.col("holder") != F.col("instrument_id")) & (F.col("start_date") <= F.col("span_end")) & (F.col("end_date") >= F.col("span_start")))
    key = ["instrument_id", "span_start", "span_end"]
    cut = lambda df: [F.greatest("start_date", "span_start").alias("start_date"), F.least("end_date", "span_end").alias("end_date")]
    own_id = [*key, "identifier"]
    mine = merge_ranges(own.select(*own_id, *cut(own)), own_id).select(*own_id, "start_date", "end_date", F.lit(1).alias("mine"), F.lit(0).alias("theirs"))
    others = rival.select(*own_id, *cut(rival), F.lit(0).alias("mine"), F.lit(1).alias("theirs"))
    held = mine.union(others)
    # All cuts of a span, by whatever identifier, and the state of each of its identifiers in each part.
    ends = own.select(*key, *cut(own)).union(rival.select(*key, *cut(rival)))
    cuts = ends.select(*key, F.explode(F.array("start_date", F.date_add("end_date", 1))).alias("first"))
    cuts = cuts.union(wanted.select(*key, F.col("span_start").alias("first"))).filter(F.col("first") <= F.col("span_end")).distinct()
    w = Window.partitionBy(*key).orderBy("first")
    parts = cuts.withColumn("last", F.coalesce(F.date_sub(F.lead("first").over(w), 1), F.col("span_end")))
    zero = [F.lit(0).alias("mine"), F.lit(0).alias("theirs")]
    marks = keys.join(cuts, key).select(*own_id, "first", *zero)
    state = _running(_changes(held, own_id, ["mine", "theirs"]).union(marks), own_id, ["mine", "theirs"])
    state = state.filter("mine > 0").groupBy(*key, "first").agg(F.count("*").alias("n"), F.max("theirs").alias("theirs"), F.min("identifier").alias("identifier"))
    status = F.when(F.col("n").isNull(), "zero_matches").when((F.col("n") > 1) | (F.col("theirs") > 0), "multiple_matches").otherwise("resolved")
    rows = parts.join(state, [*key, "first"], "left")
    return rows.select(*key, "first", "last", status.alias("status"), F.when(F.col("n") == 1, F.col("identifier")).alias("identifier"))


def plan_segments(aliases: DataFrame, evidence: DataFrame, start: str, end: str) -> DataFrame:
    """Requests by ticker as ready and blocked spans: (ticker, first, last, status, instrument_id, identifier).

    Parts of [start, end] without exactly one owner are alias_zero or alias_multiple; those with one
    are cut by its identifiers. An identifier "ticker:X" of another ticker than the one asked for is
    identifier_alias_mismatch; an empty part of weekend days is a non_session_gap. Within an owner's
    span, ready parts of one identifier join where nothing, or one such gap, lies between.
    """
    segments = alias_segments(aliases, start, end)
    weekend = weekend_only(F.col("first"), F.col("last"))
    none = F.lit(None).cast("string")
    blocked = segments.filter("status <> 'resolved'").select("ticker", "first", "last", F.when((F.col("status") == "zero") & weekend, "non_session_gap").otherwise(F.concat(F.lit("alias_"), "status")).alias("status"), none.alias("instrument_id"), none.alias("identifier"), F.col("first").alias("span_start"))
    owned = segments.filter("status = 'resolved'").select("ticker", F.col("owner").alias("instrument_id"), F.col("first").alias("start_date"), F.col("last").alias("end_date"))
    parts = identifier_ranges(evidence, owned.drop("ticker").distinct())
    rows = owned.withColumnsRenamed({"start_date": "span_start", "end_date": "span_end"}).join(parts, ["instrument_id", "span_start", "span_end"])
    other = F.col("identifier").startswith("ticker:") & (F.upper(F.substring("identifier", 8, 100)) != F.col("ticker"))
    status = (
        F.when((F.col("status") == "zero_matches") & weekend, "non_session_gap").when((F.col("status") == "resolved") & other, "identifier_alias_mismatch")
        .when(F.col("status") == "resolved", "ready").otherwise(F.concat(F.lit("identifier_"), "status"))
    )
    planned = blocked.union(rows.select("ticker", "first", "last", status.alias("status"), "instrument_id", "identifier", "span_start"))
    # A gap between two ready parts takes part in the run they form, and a run of ready parts is one.
    w = Window.partitionBy("ticker", "span_start").orderBy("first")
    gap, ready = F.col("status") == "non_session_gap", F.col("status") == "ready"
    near = planned.withColumns({"before": F.lag(F.struct("status", "instrument_id", "identifier")).over(w), "before2": F.lag(F.struct("status", "instrument_id", "identifier"), 2).over(w), "after": F.lead(F.struct("status", "instrument_id", "identifier")).over(w)})
    own = F.struct("status", "instrument_id", "identifier")
    bridged = gap & (F.col("before.status") == "ready") & (F.col("after.status") == "ready") & F.col("before").eqNullSafe(F.col("after"))
    joins = ready & (F.col("before").eqNullSafe(own) | ((F.col("before.status") == "non_session_gap") & F.col("before2").eqNullSafe(own)))
    runs = near.withColumns({"bridged": F.coalesce(bridged, F.lit(False)), "new": (~F.coalesce(joins, F.lit(False))).cast("int")})
    runs = runs.filter("NOT bridged").withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("ticker", "span_start", "run", "status", "instrument_id", "identifier").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return out.select("ticker", "first", "last", "status", "instrument_id", "identifier")


def metadata_agrees(archive: DataFrame, metadata: DataFrame, lag_days: int = 7) -> DataFrame:
    """(ticker, mismatches): fields in which an instrument's metadata departs from its archive record.

    Ticker, exchange and start must be equal; the end may lie up to ``lag_days`` before the archive's,
    never after it.
    """
    m = metadata.select(F.upper("ticker").alias("ticker"), F.col("exchange").alias("m_exchange"), F.col("start_date").alias("m_start"), F.col("end_date").alias("m_end"), F.lit(1).alias("found"))
    rows = archive.select("ticker", "exchange", "start_date", "end_date").join(m, "ticker", "left")
    lag = F.datediff("end_date", "m_end")
    wrong = [
        F.when(F.col("found").isNull(), "ticker"), F.when(~F.col("exchange").eqNullSafe(F.col("m_exchange")), "exchange"),
        F.when(~F.col("start_date").eqNullSafe(F.col("m_start")), "start_date"), F.when(F.coalesce((lag < 0) | (lag > lag_days), F.lit(True)), "end_date"),
    ]
    return rows.select("ticker", F.concat_ws(",", *wrong).alias("mismatches"))


def identifier_resolve(evidence: DataFrame, start: str, end: str) -> DataFrame:
    """For each instrument whether validated evidence covers the whole span, and others claim its identifier."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = evidence.filter((F.col("start_date") <= hi) & (F.col("end_date") >= lo))
    owners = inside.groupBy("identifier").agg(F.countDistinct("instrument_id").alias("owners"))
    good = interval_cover(inside.filter("state = 'validated'").select("instrument_id", "start_date", "end_date"), start, end).select("instrument_id", "covered")
    claims = inside.join(owners, "identifier").groupBy("instrument_id").agg(F.max("owners").alias("owners"))
    rows = claims.join(good, "instrument_id", "left")
    status = F.when(F.col("owners") > 1, "conflict").when(F.coalesce("covered", F.lit(False)), "resolved").otherwise("incomplete")
    return rows.select("instrument_id", "owners", status.alias("status"))


def _with_reach(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges with the latest end of those that start before them."""
    w = Window.partitionBy(*keys).orderBy("start_date", "end_date")
    return ranges.withColumn("reach", F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1)))


def merge_ranges(ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Join ranges that overlap or touch."""
    keys = keys or ["instrument_id"]
    w = Window.partitionBy(*keys).orderBy("start_date", "end_date")
    new = F.coalesce(F.col("start_date") > F.date_add("reach", 1), F.lit(True))
    island = _with_reach(ranges, keys).withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("n_ranges")).drop("island")


def weekend_only(first, last):
    """Whether the closed range has no weekday; an empty range has none."""
    return (first > last) | ((F.datediff(last, first) <= 1) & (F.weekday(first) >= 5) & (F.weekday(last) >= 5))


def interval_cover(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Whether an instrument's ranges cover [start, end] but for gaps of weekend days: (instrument_id, n_gaps, covered)."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    cut = ranges.select("instrument_id", F.greatest("start_date", lo).alias("start_date"), F.least("end_date", hi).alias("end_date")).filter("start_date <= end_date")
    inner = _with_reach(cut, ["instrument_id"]).select("instrument_id", F.date_add(F.coalesce("reach", F.date_sub(lo, 1)), 1).alias("a"), F.date_sub("start_date", 1).alias("b"))
    tail = cut.groupBy("instrument_id").agg(F.date_add(F.max("end_date"), 1).alias("a")).select("instrument_id", "a", hi.alias("b"))
    gaps = inner.unionByName(tail)
    return gaps.groupBy("instrument_id").agg(F.count_if(~weekend_only(F.col("a"), F.col("b"))).alias("n_gaps")).withColumn("covered", F.col("n_gaps") == 0)


def coalesce_segments(segments: DataFrame) -> DataFrame:
    """Join neighbouring segments of one owner where nothing but weekend days lies between."""
    w = Window.partitionBy("instrument_id").orderBy("start_date", "end_date")
    rows = _with_reach(segments, ["instrument_id"])
    new = F.coalesce(~weekend_only(F.date_add("reach", 1), F.date_sub("start_date", 1)), F.lit(True))
    island = rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("instrument_id", "island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("n_segments")).drop("island")


def universe_resolve(universe: DataFrame, aliases: DataFrame) -> DataFrame:
    """(year, ticker, n_instruments, status): who had the ticker at any time of the year."""
    years = aliases.select("ticker", "instrument_id", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("year")).distinct()
    n = universe.join(years, ["year", "ticker"], "left").groupBy("year", "ticker").agg(F.countDistinct("instrument_id").alias("n_instruments"))
    return n.withColumn("status", F.when(F.col("n_instruments") == 1, "resolved").when(F.col("n_instruments") == 0, "unresolved").otherwise("ambiguous"))


def unique_tickers(aliases: DataFrame, day: str) -> DataFrame:
    """Tickers with exactly one owner on a day."""
    on = aliases.filter(F.lit(day).cast("date").between(F.col("start_date"), F.col("end_date")))
    return on.groupBy("ticker").agg(F.countDistinct("instrument_id").alias("n"), F.min("instrument_id").alias("instrument_id")).filter("n = 1").select("ticker", "instrument_id")


def latest_alias(aliases: DataFrame) -> DataFrame:
    """The ticker each instrument had last; ties to the later start, then the smaller ticker."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("end_date"), F.desc("start_date"), "ticker")
    return aliases.withColumn("n", F.row_number().over(w)).filter("n = 1").select("instrument_id", "ticker")


def archive_effective(records: DataFrame) -> DataFrame:
    """Of each anchor's records the one that ends last."""
    w = Window.partitionBy("anchor").orderBy(F.desc("end_date"), F.desc("start_date"), F.desc("ticker"))
    return records.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def archive_overlaps(records: DataFrame) -> DataFrame:
    """Ranges that two anchors share under one ticker."""
    a, b = records.alias("a"), records.alias("b")
    both = a.join(b, (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.anchor") < F.col("b.anchor")))
    rows = both.select(F.col("a.ticker").alias("ticker"), F.col("a.anchor").alias("anchor_a"), F.col("b.anchor").alias("anchor_b"), F.greatest("a.start_date", "b.start_date").alias("start_date"), F.least("a.end_date", "b.end_date").alias("end_date"))
    return rows.filter("start_date <= end_date")


def identity_sources(aliases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Alias rows with exactly one identifier of the same span whose name is the ticker, case aside."""
    e = evidence.select("instrument_id", F.lower("name").alias("k"), "start_date", "end_date", "identifier")
    a = aliases.withColumn("k", F.lower("ticker"))
    both = a.join(e, ["instrument_id", "k", "start_date", "end_date"])
    one = both.groupBy("instrument_id", "ticker", "start_date", "end_date").agg(F.count("*").alias("n"), F.min("identifier").alias("identifier"))
    return one.filter("n = 1").drop("n")


def episode_gaps(bars: DataFrame, indexed: DataFrame, longest: int) -> DataFrame:
    """Holes of at least ``longest`` missing sessions between two bars of an instrument."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    rows = bars.select("instrument_id", "date").join(F.broadcast(indexed.select(F.col("session_date").alias("date"), "session_index")), "date")
    rows = rows.select("instrument_id", "date", F.lag("date").over(w).alias("prior_date"), (F.col("session_index") - F.lag("session_index").over(w) - 1).alias("missing"))
    return rows.filter(F.col("missing") >= longest).select("instrument_id", "prior_date", F.col("date").alias("next_date"), F.col("missing").cast("int").alias("missing"))


def zero_bridges(bars: DataFrame, longest: int) -> DataFrame:
    """Runs of at least ``longest`` bars without volume, with the first traded day after each."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    zero = F.col("volume") == 0
    after = F.min(F.when(F.col("volume") > 0, F.col("date"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    runs = bars.select("instrument_id", "date", "volume", after.alias("next_traded"), F.sum((~zero).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")).filter(zero)
    out = runs.groupBy("instrument_id", "run").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"), F.min("next_traded").alias("next_traded"))
    return out.filter(F.col("n_bars") >= longest).drop("run")


def assign_episodes(bars: DataFrame, boundaries: DataFrame, fewest: int) -> DataFrame:
    """Number each instrument's episodes by the boundaries up to a bar; short episodes are quarantined."""
    marks = boundaries.select("instrument_id", F.col("next_date").alias("date"), F.lit(1).alias("cut"))
    w = Window.partitionBy("instrument_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select("instrument_id", "date").join(marks.distinct(), ["instrument_id", "date"], "left").withColumn("episode", F.coalesce(F.sum("cut").over(w), F.lit(0)))
    n = rows.groupBy("instrument_id", "episode").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))
    return n.withColumn("disposition", F.when(F.col("n_bars") < fewest, "quarantined").otherwise("kept"))
