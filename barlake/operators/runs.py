"""The built-in studies over a warehouse: parameters, candidates, selection and observations, run in two phases."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions import calendar, exprs
from barlake.operators import features, phases, ranking, registry, studies
from barlake.operators.catalog import Catalog
from barlake.operators.phases import Context, Gate, Lookback, Study
from barlake.sources.warehouse import Warehouse

VERSION = 1
DEFAULTS = {
    "start": "2020-01-01", "end": "2023-12-31", "gap_threshold": -0.03, "min_adv_dollars": 1_000_000, "lookback_sessions": 20, "min_hourly_density": 0.5, "target_return": 0.01,
    "periods": {"development": ["2020-01-01", "2021-12-31"], "validation": ["2022-01-01", "2022-12-31"], "test": ["2023-01-01", "2023-12-31"]},
    "metric_periods": ["development", "validation"], "benchmark_ticker": "SPY",
}
EXTRA = {
    "gap_recovery": {},
    "gap_recovery_opening": {"min_five_min_density": 0.2},
    "gap_recovery_multiday": {"min_gap_volatilities": 0.0, "stress_volatility": 0.02},
}
HORIZON_DAYS = 30  # of bars read after the last event
DAYS_A_SESSION = 2  # read before the first event, for each session of the lookback
GATE = ("duplicate_keys", "ohlc_invariants", "negative_values")
SLICES = ("asset_type", "market_regime", "market_trend")


def _days(p: Mapping) -> tuple[date, date]:
    """First and last day of the bars that a study reads."""
    start, end = date.fromisoformat(p["start"]), date.fromisoformat(p["end"])
    return start - timedelta(DAYS_A_SESSION * p["lookback_sessions"] + 10), end + timedelta(HORIZON_DAYS)


def _benchmark(context: Context) -> str:
    p = context.parameters
    return registry.resolve_benchmark(context.metadata("aliases"), p["benchmark_ticker"], p["start"], p["end"])


def _read(context: Context, dataset: str) -> DataFrame:
    first, last = _days(context.parameters)
    return context.read(dataset, start=str(first), end=str(last))


def _schedule(context: Context) -> DataFrame:
    return calendar.session_schedule(context.spark, *_days(context.parameters))


def _candidates(context: Context) -> DataFrame:
    """Gap-down sessions within the studied dates, with the density of the bars that outcomes will come from."""
    p, schedule, eod = context.parameters, _schedule(context), _read(context, "eod")
    n = p["lookback_sessions"]
    periods = {name: tuple(date.fromisoformat(d) for d in span) for name, span in p["periods"].items()}
    density = features.hourly_density(eod, _read(context, "intraday_1hour"), schedule, n)
    found = studies.gap_candidates(features.eod_features(eod, n), schedule, density, _benchmark(context), n, p["gap_threshold"], p["min_adv_dollars"], periods)
    if "min_five_min_density" in p:
        five = features.density(eod, _read(context, "intraday_5min"), calendar.expected_labels(schedule, "5min"), "5min", n)
        found = found.join(five.select("instrument_id", F.col("date").alias("event_date"), "five_min_density"), studies.EVENT, "left")
    return found.filter(F.col("event_date").between(F.lit(p["start"]).cast("date"), F.lit(p["end"]).cast("date")))


def _select(context: Context, eligible: DataFrame) -> DataFrame:
    p = context.parameters
    least = {"hourly_density": p["min_hourly_density"]} | ({"five_min_density": p["min_five_min_density"]} if "min_five_min_density" in p else {})
    return studies.large_gaps(studies.dense(eligible, **least), p.get("min_gap_volatilities", 0.0))


def _metrics(context: Context, observations: DataFrame, slices: tuple[str, ...] = (), extra: Mapping | None = None) -> DataFrame:
    """Metrics of the reported periods by period and checkpoint, and by each slice of them."""
    reported = observations.filter(F.col("period").isin(context.parameters["metric_periods"]))
    out = None
    for keys in [("period", "observation_label"), *(("period", "observation_label", s) for s in slices)]:
        tidy = studies.tidy(studies.summarize(reported, list(keys), extra), list(keys))
        one = tidy.select("metric_name", "value", F.lit("").alias("unit"), F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]).alias("dimensions"))
        out = one if out is None else out.unionByName(one)
    return out


def _gap(context: Context, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = studies.gap_observations(selected, _read(context, "intraday_1hour"), _read(context, "eod"), _schedule(context), _benchmark(context), context.parameters["target_return"])
    return rows, _metrics(context, rows)


def _opening(context: Context, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    five, hourly = _read(context, "intraday_5min"), _read(context, "intraday_1hour")
    rows = studies.opening_observations(selected, five, hourly, _schedule(context), _benchmark(context), context.parameters["target_return"])
    return rows, _metrics(context, rows, extra=studies.opening_extra())


def _multiday(context: Context, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By asset type where the warehouse knows it (metadata relation instruments), by regime and trend of the benchmark."""
    p, eod = context.parameters, _read(context, "eod")
    kinds = context.metadata("instruments").select("instrument_id", "asset_type") if context.has_metadata("instruments") else eod.select("instrument_id").distinct().withColumn("asset_type", F.lit(None).cast("string"))
    rows = studies.multiday_observations(selected, eod, calendar.with_index(_schedule(context)), kinds, _benchmark(context), p["target_return"])
    rows = rows.withColumns({"market_regime": exprs.market_regime(F.col("benchmark_realized_vol"), p["stress_volatility"]), "market_trend": exprs.market_trend(F.col("benchmark_prior_window_return"))})
    return rows, _metrics(context, rows, SLICES)


OBSERVE = {"gap_recovery": _gap, "gap_recovery_opening": _opening, "gap_recovery_multiday": _multiday}
SELECTION = {"gap_recovery": ("eod", "intraday_1hour"), "gap_recovery_opening": ("eod", "intraday_1hour", "intraday_5min"), "gap_recovery_multiday": ("eod", "intraday_1hour")}


def study(name: str, parameters: Mapping) -> Study:
    """A built-in study as the two-phase runner takes it."""
    first, last = _days(parameters)
    return Study(
        name, VERSION, SELECTION[name], (), (Lookback("eod", "lookback_start_date", "prior_date"),), Gate(GATE, ("eod",), str(first), str(last)), _candidates, _select, OBSERVE[name], (first, last),
    )


def _runner(name: str):
    def run(store: Warehouse, catalog: Catalog, parameters: Mapping) -> str:
        p = registry.normalize_parameters(parameters, DEFAULTS | EXTRA[name], name)
        return phases.run(study(name, p), store, catalog, p)

    return run


for _name in OBSERVE:
    registry.register(_name, _runner(_name), replace=True)


def rank(catalog: Catalog, run_ids: list[str], checkpoint: str, pairs: list[tuple], names: DataFrame, least_events: int = ranking.MIN_EVENTS, least_lift: float = ranking.MIN_LIFT) -> list[str]:
    """The two-pass ranking of published observations as lines of text."""
    scoped = ranking.scope(catalog.load_observations(run_ids), checkpoint).persist()
    try:
        windows = ranking.windows(catalog.spark, pairs)
        candidates = ranking.select_candidates(scoped, windows, least_events, least_lift)
        evaluated = ranking.evaluate_candidates(scoped, windows, candidates.filter("selected"))
        return ranking.render_two_pass(ranking.evaluation_summary(scoped, windows, evaluated), candidates, evaluated, names)
    finally:
        scoped.unpersist()
