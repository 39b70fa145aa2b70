"""Gap-recovery studies: candidates, screens, outcomes at checkpoints and tidy metrics.

Selection reads only decision features; outcomes are joined to events chosen before. Checkpoint
grids are a handful of literal rows, so they multiply events by a constant.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import exprs

HOURS = (10, 11, 12, 13, 14, 15)
MINUTES = (5, 15, 30, 60, 90, 150, 210, 270, 330, 390)
HORIZONS = (0, 1, 2, 3, 5, 10)
FIRST_BAR = 5
SESSION_CLOSE = "session_close"
EVENT = ["instrument_id", "event_date"]


def gap_candidates(features: DataFrame, schedule: DataFrame, density: DataFrame, benchmark: str, lookback: int, gap: float, min_adv: float, periods: Mapping[str, tuple[date, date]]) -> DataFrame:
    """Gap-down sessions with a full lookback, beside the benchmark's features of the same date."""
    bench = F.broadcast(
        features.filter(F.col("instrument_id") == benchmark).select(
            "date", F.col("gap_return").alias("benchmark_gap_return"), F.col("open_raw").alias("benchmark_open_raw"), F.col("adj_open").alias("benchmark_adj_open"),
            F.col("realized_vol").alias("benchmark_realized_vol"), F.col("prior_window_return").alias("benchmark_prior_window_return"),
        )
    )
    chosen = features.filter((F.col("instrument_id") != benchmark) & (F.col("prior_sessions_present") == lookback) & (F.col("gap_return") <= gap) & (F.col("adv_dollars") >= min_adv))
    return (
        chosen.join(F.broadcast(schedule).select(F.col("session_date").alias("date"), F.col("session_open").alias("decision_ts")), "date")
        .join(density.drop("prior_traded_bars", "prior_expected_bars"), ["instrument_id", "date"], "left")
        .join(bench, "date", "left")
        .withColumnRenamed("date", "event_date")
        .withColumn("hourly_lookback_start", exprs.ny_to_utc(F.col("prior_date"), 10))
        .withColumn("period", exprs.period_label(F.col("event_date"), periods))
    )


def dense(candidates: DataFrame, **least: float) -> DataFrame:
    """Keep events whose density columns reach their minimum; an unknown density counts as 0."""
    for column, minimum in least.items():
        candidates = candidates.filter(F.coalesce(F.col(column), F.lit(0.0)) >= minimum)
    return candidates


def large_gaps(candidates: DataFrame, least: float) -> DataFrame:
    """Keep gaps of at least so many volatilities; 0 keeps all."""
    return candidates if least <= 0 else candidates.filter(F.col("gap_vol_normalized") <= -least)


def of_events(bars: DataFrame, events: DataFrame, benchmark: str, day: Column) -> DataFrame:
    """Bars of the events' instruments and the benchmark on the events' days."""
    ids = events.select("instrument_id").union(events.sparkSession.createDataFrame([(benchmark,)], "instrument_id string")).distinct()
    days = events.select(F.col("event_date").alias("session_date")).distinct()
    return bars.withColumn("session_date", day).join(ids, "instrument_id", "left_semi").join(days, "session_date", "left_semi")


def valid_hourly(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Hourly bars on a New York clock hour from 10:00 that end by the close, with ordered prices."""
    local = exprs.ny(F.col("ts"))
    rows = bars.withColumns({"session_date": local.cast("date"), "ny_hour": F.hour(local), "ny_minute": F.minute(local)})
    rows = rows.join(F.broadcast(schedule.select("session_date", "session_close")), "session_date")
    return rows.filter((F.col("ny_minute") == 0) & (F.col("ny_hour") >= 10) & (F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.col("session_close")) & exprs.valid_ordering())


def valid_5min(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Five-minute bars aligned to the open that end by the close, with ordered prices."""
    rows = bars.withColumn("session_date", exprs.ny_date(F.col("ts"))).join(F.broadcast(schedule.select("session_date", "session_open", "session_close")), "session_date")
    start = exprs.minutes_between(F.col("session_open"), F.col("ts"))
    rows = rows.withColumn("end_minutes", start + 5)
    return rows.filter((start >= 0) & (start % 5 == 0) & (F.col("ts") + F.expr("INTERVAL 5 MINUTE") <= F.col("session_close")) & exprs.valid_ordering())


def measures(rows: DataFrame, price: str, basis: str, prior: str, target: float, recovered: str, same_basis: Column) -> DataFrame:
    """Outcome status, returns and excursions from the event's open, and the recovered share of the gap."""
    p, o = F.col(price), F.col(basis)
    rows = rows.withColumns(
        {
            "outcome_status": F.when(p.isNull(), "missing_outcome").otherwise("evaluable"),
            "measured_return": p / o - 1,
            "max_favorable_excursion": F.col("max_high") / o - 1,
            "max_adverse_excursion": F.col("min_low") / o - 1,
            "benchmark_return": exprs.ratio_minus_one(F.col("benchmark_price"), F.col("benchmark_basis")),
        }
    )
    return rows.withColumns(
        {
            "excess_return": F.col("measured_return") - F.col("benchmark_return"),
            recovered: F.when(same_basis & (F.col(prior) != o), (p - o) / (F.col(prior) - o)),
            "reached_target_at_checkpoint": F.col("measured_return") >= target,
        }
    )


def _paths(bars: DataFrame, column: str, marks: tuple[int, ...], at: Mapping[str, Column], upto: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(event, path): for each instrument's session one entry a mark, with the bar at it and what all bars up to it show.

    The marks are a handful of literals, so that one aggregate by session holds them all; no bar is repeated.
    """
    entries = [
        F.struct(*[F.max(F.when(F.col(column) == m, value)).alias(name) for name, value in at.items()], *[measure(F.col(column) <= m).alias(name) for name, measure in upto.items()]) for m in marks
    ]
    return bars.groupBy(*EVENT).agg(F.array(*entries).alias("path"))


_EXTREMES = {"max_high": lambda held: F.max(F.when(held, F.col("high"))), "min_low": lambda held: F.min(F.when(held, F.col("low")))}


def gap_observations(events: DataFrame, hourly: DataFrame, eod: DataFrame, schedule: DataFrame, benchmark: str, target: float) -> DataFrame:
    """Each event at six hourly closes and the session close, missing outcomes as rows of their own."""
    valid = valid_hourly(of_events(hourly, events, benchmark, exprs.ny_date(F.col("ts"))).drop("session_date"), schedule).withColumnRenamed("session_date", "event_date")
    paths = _paths(valid, "ny_hour", HOURS, {"available": F.col("ts") + F.expr("INTERVAL 1 HOUR"), "checkpoint_price": F.col("close")}, _EXTREMES)
    bench = paths.filter(F.col("instrument_id") == benchmark).select("event_date", F.col("path.checkpoint_price").alias("benchmark_path"))
    each = events.join(paths, EVENT, "left").join(F.broadcast(bench), "event_date", "left").select("*", F.posexplode(F.array(*map(F.lit, HOURS))).alias("place", "checkpoint_hour"))
    own = F.get("path", F.col("place"))
    at_hours = each.withColumns(
        {**{name: own[name] for name in ("available", "checkpoint_price", "max_high", "min_low")}, "benchmark_price": F.get("benchmark_path", F.col("place")), "observation_label": exprs.hour_label(F.col("checkpoint_hour"))}
    ).drop("path", "benchmark_path", "place", "checkpoint_hour")
    days = eod.select("instrument_id", F.col("date").alias("event_date"), "close", "high", "low")
    day = days.select(*EVENT, F.col("close").alias("checkpoint_price"), F.col("high").alias("max_high"), F.col("low").alias("min_low"))
    day_bench = days.filter(F.col("instrument_id") == benchmark).select("event_date", F.col("close").alias("benchmark_price"))
    closes = F.broadcast(schedule.select(F.col("session_date").alias("event_date"), F.col("session_close").alias("available")))
    at_close = events.join(closes, "event_date").join(day, EVENT, "left").join(F.broadcast(day_bench), "event_date", "left").withColumn("observation_label", F.lit(SESSION_CLOSE))
    rows = at_hours.unionByName(at_close).withColumn("benchmark_basis", F.col("benchmark_open_raw"))
    return measures(rows, "checkpoint_price", "open_raw", "prior_close_raw", target, "gap_recovered_fraction", ~F.col("event_day_corporate_action"))


def opening_observations(events: DataFrame, five: DataFrame, hourly: DataFrame, schedule: DataFrame, benchmark: str, target: float) -> DataFrame:
    """Each event at ten five-minute checkpoints, also measured from the first bar and against hourly bars."""
    valid = valid_5min(of_events(five, events, benchmark, exprs.ny_date(F.col("ts"))).drop("session_date"), schedule).withColumnRenamed("session_date", "event_date")
    some = lambda held, n: F.when(F.count_if(held) > 0, n)  # noqa: E731  unknown before the first bar
    counted = {
        "bars_through_checkpoint": lambda held: some(held, F.count_if(held)), "zero_volume_bars": lambda held: some(held, F.count_if(held & (F.col("volume") == 0))),
    }
    paths = _paths(valid, "end_minutes", MINUTES, {"checkpoint_price": F.col("close"), "checkpoint_bar_volume": F.col("volume")}, _EXTREMES | counted)
    local = exprs.ny(F.col("ts"))
    hours = hourly.withColumn("event_date", local.cast("date")).join(F.broadcast(schedule.withColumnRenamed("session_date", "event_date")), "event_date")
    hours = hours.filter((F.minute(local) == 0) & (F.hour(local) >= 10) & (F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.col("session_close")))
    hours = hours.withColumn("end_minutes", exprs.minutes_between(F.col("session_open"), F.col("ts")) + 60)
    hours = _paths(hours, "end_minutes", MINUTES, {"hourly_close": F.col("close")}, {}).withColumnRenamed("path", "hourly_path")
    bench = paths.filter(F.col("instrument_id") == benchmark).select("event_date", F.col("path.checkpoint_price").alias("benchmark_path"))
    each = events.join(paths, EVENT, "left").join(hours, EVENT, "left").join(F.broadcast(bench), "event_date", "left")
    each = each.select("*", F.posexplode(F.array(*map(F.lit, MINUTES))).alias("place", "checkpoint_minutes"))
    first, own = F.get("path", F.lit(MINUTES.index(FIRST_BAR))), F.get("path", F.col("place"))
    taken = ("checkpoint_price", "checkpoint_bar_volume", "max_high", "min_low", "bars_through_checkpoint", "zero_volume_bars")
    rows = each.withColumns(
        {
            "first_bar_close": first["checkpoint_price"], "first_bar_volume": first["checkpoint_bar_volume"], **{name: own[name] for name in taken}, "hourly_close": F.get("hourly_path", F.col("place"))["hourly_close"],
            "benchmark_price": F.get("benchmark_path", F.col("place")), "observation_label": exprs.minute_label(F.col("checkpoint_minutes")), "benchmark_basis": F.col("benchmark_open_raw"),
        }
    ).drop("path", "hourly_path", "benchmark_path", "place")
    rows = measures(rows, "checkpoint_price", "open_raw", "prior_close_raw", target, "gap_recovered_fraction", ~F.col("event_day_corporate_action"))
    from_first = exprs.ratio_minus_one(F.col("checkpoint_price"), F.col("first_bar_close"))
    return rows.withColumns(
        {
            "return_from_first_bar": from_first,
            "reached_target_from_first_bar": from_first >= target,
            "hourly_matches_5min": F.when(F.col("hourly_close").isNotNull(), F.col("hourly_close") == F.col("checkpoint_price")),
        }
    )


def _session_steps(indexed: DataFrame) -> DataFrame:
    """(date, step) of every day up to the last session: ten a session, which itself ends its ten.

    A day without session has the ten of the next one, so that a path of days is a range of steps.
    """
    before = F.coalesce(F.lag("session_date").over(Window.orderBy("session_date")), F.date_sub("session_date", 1))
    days = indexed.select("session_date", "session_index", before.alias("before"))
    each = days.select(F.explode(F.sequence(F.date_add("before", 1), "session_date")).alias("date"), "session_date", "session_index")
    return each.select("date", (F.col("session_index") * 10 + F.when(F.col("date") == F.col("session_date"), 9).otherwise(0)).alias("step"))


def multiday_path(events: DataFrame, eod: DataFrame, indexed: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """For each event and horizon the target date, its adjusted close, and the adjusted extremes of the days up to it.

    Events stand as marks, with all their columns, among their instrument's bars in the order of sessions; one
    sort by instrument gives a mark every horizon's range and the bar at its end, and nothing is joined by day.
    """
    calendar = F.broadcast(indexed.select("session_date", "session_index"))
    start = calendar.select(F.col("session_date").alias("event_date"), F.col("session_index").alias("at"))
    target = calendar.select(F.col("session_date").alias("target_date"), F.col("session_index").alias("target_index"))
    prices = ["adj_high", "adj_low", "adj_close"]
    marks = events.select("instrument_id", F.col("event_date").alias("date"), *[F.lit(None).cast("double").alias(c) for c in prices], F.lit(0).alias("bar"), F.struct(*events.columns).alias("event"))
    bars = eod.select("instrument_id", "date", *prices, F.lit(1).alias("bar"), F.lit(None).cast(marks.schema["event"].dataType).alias("event"))
    rows = bars.union(marks).join(F.broadcast(_session_steps(indexed)), "date")
    order = Window.partitionBy("instrument_id").orderBy("step")
    ahead = {h: order.rangeBetween(0, 10 * h) for h in horizons}
    parts = [
        F.struct(
            F.lit(h).alias("horizon"), F.max("adj_high").over(w).alias("max_high"), F.min("adj_low").over(w).alias("min_low"), F.sum("bar").over(w).alias("n"),
            F.max(F.struct("step", F.col("adj_close").alias("price"))).over(w).alias("end"),
        ) for h, w in ahead.items()
    ]
    path = rows.select("event", "bar", F.array(*parts).alias("paths")).filter("bar = 0").select("event.*", F.explode("paths").alias("path"))
    grid = path.withColumn("horizon", F.col("path.horizon")).join(start, "event_date")
    grid = grid.withColumn("target_index", F.col("at") + F.col("horizon")).join(target, "target_index", "left")
    known = F.col("target_date").isNotNull() & (F.col("path.n") > 0)
    taken = {"max_high": "path.max_high", "min_low": "path.min_low", "sessions_observed": "path.n"}
    # The last step is the target session's own where there is a bar of that day.
    price = F.when(F.col("target_date").isNotNull() & (F.col("path.end.step") == F.col("target_index") * 10 + 9), F.col("path.end.price"))
    return grid.withColumns({**{name: F.when(known, F.col(c)) for name, c in taken.items()}, "checkpoint_price": price}).drop("at", "target_index", "path")


def multiday_observations(events: DataFrame, eod: DataFrame, indexed: DataFrame, asset_types: DataFrame, benchmark: str, target: float, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each event at the adjusted closes of later sessions, by horizon."""
    bench = eod.filter(F.col("instrument_id") == benchmark).select(F.col("date").alias("target_date"), F.col("adj_close").alias("benchmark_price"))
    # Types join events, before there is a row for each horizon.
    typed = events.join(asset_types, "instrument_id", "left").withColumn("asset_type", F.coalesce("asset_type", F.lit("unknown")))
    rows = (
        multiday_path(typed, eod, indexed, horizons).join(F.broadcast(bench), "target_date", "left")
        .withColumn("observation_label", F.concat(F.lit("session_plus_"), F.col("horizon"))).withColumn("benchmark_basis", F.col("benchmark_adj_open"))
    )
    rows = measures(rows, "checkpoint_price", "adj_open", "prior_adj_close", target, "gap_recovered_fraction", F.lit(True))
    return rows.withColumn("touched_target", F.col("max_favorable_excursion") >= target)


QUANTILES = {"median_return": 0.5, "p10_return": 0.1, "p90_return": 0.9}
BINS = 1_000  # a unit of a return


def _same(keys: list[str], prefix: str) -> Column:
    """Equality, of nulls too, of the keys with those under a prefix."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float], small: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` by the keys, interpolated between neighbours; unknown values don't count.
    ``small`` says that the keys form few groups, whose wanted bins are then broadcast and no value moves for them.

    A first pass counts values by narrow bins. Its sums say which bins hold the ranks that are wanted,
    and only those bins' values are counted and put in order: no task sees all values of a group.
    """
    held = rows.filter(F.col(value).isNotNull()).withColumn("bin", F.floor(F.col(value) * BINS))
    by, of = Window.partitionBy(*keys), [*keys, "bin"]
    upto = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = held.groupBy(*of).agg(F.count("*").alias("n")).select(*of, (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(by).alias("total"))
    place = {name: p * (F.col("total") - 1) for name, p in wanted.items()}
    ranks = [r for at in place.values() for r in (F.floor(at), F.ceil(at))]
    inside = F.lit(False)
    for r in ranks:
        inside = inside | ((F.col("before") <= r) & (r < F.col("upto")))
    # Two bins at most for each quantile of a group; Spark knows the size and chooses how to join.
    few = bins.filter(inside).select(*[F.col(c).alias(f"bin_{c}") for c in of], "before", "total")
    few = F.broadcast(few) if small else few
    values = held.join(few, _same(of, "bin_")).groupBy(*of, "before", "total", value).agg(F.count("*").alias("n"))
    within = Window.partitionBy(*of).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = values.withColumn("upto", F.col("before") + F.sum("n").over(within))
    at_rank = lambda r: F.min(F.when(F.col("upto") > r, F.col(value)))
    sides = [side for name, at in place.items() for side in (at_rank(F.floor(at)).alias(f"{name}_low"), at_rank(F.ceil(at)).alias(f"{name}_high"))]
    out = counted.groupBy(*keys, "total").agg(*sides)
    between = lambda name, at: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at))
    return out.select(*keys, *[between(name, at).alias(name) for name, at in place.items()])


def summarize(observations: DataFrame, keys: list[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Aggregates of observations by the keys: two denominators for hit rates, exact quantiles of returns."""
    ok = F.col("outcome_status") == "evaluable"
    hits = F.count_if(ok & F.col("reached_target_at_checkpoint"))
    evaluable = F.count_if(ok)
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    plain = {
        "evaluable": evaluable,
        "missing_outcome": F.count_if(~ok),
        "mean_return": mean("measured_return"),
        "mean_excess_return": mean("excess_return"),
        "mean_favorable_excursion": mean("max_favorable_excursion"),
        "mean_adverse_excursion": mean("max_adverse_excursion"),
        "mean_gap_recovered_fraction": mean("gap_recovered_fraction"),
        "hit_rate_target": exprs.ratio(hits, evaluable),
        "hit_rate_target_missing_as_miss": hits / F.count("*"),
        **(extra or {}),
    }
    base = observations.groupBy(*keys).agg(*[c.alias(n) for n, c in plain.items()])
    found = quantiles(observations.filter(ok), keys, "measured_return", QUANTILES, small=True)  # keys of a summary are labels
    found = found.select(*[F.col(k).alias(f"of_{k}") for k in keys], *QUANTILES)  # a row for each group
    rows = base.join(found, _same(keys, "of_"), "left")
    names = ["evaluable", "missing_outcome", "mean_return", *QUANTILES, *[n for n in plain if n not in ("evaluable", "missing_outcome", "mean_return")]]
    return rows.select(*keys, *[(F.col(n) if n in ("evaluable", "missing_outcome") else F.round(n, 6)).alias(n) for n in names])


def opening_extra() -> dict[str, Column]:
    """Measures that only the opening study has."""
    ok = F.col("outcome_status") == "evaluable"
    first = ok & F.col("return_from_first_bar").isNotNull()
    matched = ok & F.col("hourly_matches_5min").isNotNull()
    bars = F.sum(F.when(ok, F.col("bars_through_checkpoint")))
    return {
        "mean_return_from_first_bar": F.avg(F.when(first, F.col("return_from_first_bar"))),
        "hit_rate_from_first_bar": exprs.ratio(F.count_if(first & F.col("reached_target_from_first_bar")), F.count_if(first)),
        "zero_volume_share": exprs.ratio(F.sum(F.when(ok, F.col("zero_volume_bars"))), bars),
        "hourly_agreement_rate": exprs.ratio(F.count_if(matched & F.col("hourly_matches_5min")), F.count_if(matched)),
    }


def tidy(metrics: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimensions, metric_name, value) of every measure that has a value."""
    names = [c for c in metrics.columns if c not in dimensions]
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return metrics.select(*dimensions, F.expr(f"stack({len(names)}, {pairs}) AS (metric_name, value)")).filter("value IS NOT NULL")
