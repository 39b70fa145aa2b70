"""Event studies: candidates, audit, observations, metrics and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions import calendar, exprs
from barlake.operators import catalog, events, features, phases, ranking, studies
from barlake.plans import oracle
from barlake.plans import settings as S
from barlake.plans.frames import keep, own_warehouse
from barlake.plans.registry import plan
from barlake.sources.derive import EVENT_END, EVENT_START

EVENT = "instrument_id, event_date"
DECISION = "open_raw adj_open prior_close_raw prior_adj_close benchmark_open_raw benchmark_adj_open".split()
FEATURES = "adv_dollars realized_vol prior_5_return gap_return gap_vol_normalized hourly_density benchmark_gap_return benchmark_realized_vol".split()
OUTCOMES = "measured_return max_favorable_excursion max_adverse_excursion benchmark_return excess_return gap_recovered_fraction".split()
CANDIDATE = ["instrument_id", "event_date", "decision_ts", "lookback_start_date", "prior_date", "hourly_lookback_start", "prior_sessions_present", "event_day_corporate_action", "period", *DECISION]


def _sql(columns, rounded, relation):
    return f"SELECT {', '.join(columns)}, {', '.join(f'round({c}, 6) AS {c}' for c in rounded)} FROM {relation}"


def _out(df, columns, rounded):
    return df.select(*columns, *[F.round(c, 6).alias(c) for c in rounded])


@plan("gap_candidates", _sql(CANDIDATE, FEATURES, "cand"))
def _(t):
    return _out(t.cand, CANDIDATE, FEATURES)


@plan("density_screen", f"SELECT {EVENT}, round(hourly_density, 6) AS hourly_density, round(five_min_density, 6) AS five_min_density FROM (SELECT c.instrument_id, c.event_date, c.hourly_density, d.five_min_density FROM cand c LEFT JOIN density_f d ON d.instrument_id = c.instrument_id AND d.date = c.event_date) WHERE coalesce(hourly_density, 0) >= 0.05 AND coalesce(five_min_density, 0) >= 0.005")
def _(t):
    both = t.cand.join(t.density_f.select("instrument_id", F.col("date").alias("event_date"), "five_min_density"), ["instrument_id", "event_date"], "left")
    return _out(studies.dense(both, hourly_density=0.05, five_min_density=0.005), ["instrument_id", "event_date"], ["hourly_density", "five_min_density"])


@plan("news_gap_screen", f"SELECT {EVENT}, round(gap_vol_normalized, 6) AS gap_vol_normalized FROM cand_l WHERE gap_vol_normalized <= -0.5")
def _(t):
    return _out(studies.large_gaps(t.cand_l, 0.5), ["instrument_id", "event_date"], ["gap_vol_normalized"])


@plan("valid_hourly", "SELECT instrument_id, ts, session_date, ny_hour, open, high, low, close, volume FROM valid_h")
def _(t):
    return studies.valid_hourly(t.hourly, t.sessions).select("instrument_id", "ts", "session_date", "ny_hour", "open", "high", "low", "close", "volume")


@plan("valid_5min", "SELECT instrument_id, ts, session_date, end_minutes, open, high, low, close, volume FROM valid_f")
def _(t):
    return studies.valid_5min(t.five, t.sessions).select("instrument_id", "ts", "session_date", "end_minutes", "open", "high", "low", "close", "volume")


@plan("period_label", f"SELECT {EVENT}, period FROM cand_l")
def _(t):
    return t.cand_l.select("instrument_id", "event_date", "period")


REGIME = f"CASE WHEN benchmark_realized_vol IS NULL THEN 'unknown' WHEN benchmark_realized_vol >= {S.STRESS} THEN 'stress' ELSE 'calm' END"
TREND = "CASE WHEN benchmark_prior_window_return IS NULL THEN 'unknown' WHEN benchmark_prior_window_return < 0 THEN 'down' ELSE 'up' END"


@plan("market_regime", f"SELECT {EVENT}, {REGIME} AS market_regime, {TREND} AS market_trend FROM cand_l")
def _(t):
    return t.cand_l.select("instrument_id", "event_date", exprs.market_regime(F.col("benchmark_realized_vol"), S.STRESS).alias("market_regime"), exprs.market_trend(F.col("benchmark_prior_window_return")).alias("market_trend"))


GAP_OBS = ["instrument_id", "event_date", "observation_label", "outcome_status", "available", "checkpoint_price", "max_high", "min_low", "benchmark_price", "reached_target_at_checkpoint", "period"]


@plan("gap_observations", _sql(GAP_OBS, OUTCOMES, "obs_gap"))
def _(t):
    return _out(t.obs_gap, GAP_OBS, OUTCOMES)


@plan("gap_metrics", oracle.summary("obs_gap", "period, observation_label"))
def _(t):
    return studies.summarize(t.obs_gap, ["period", "observation_label"])


MEASURES = "evaluable missing_outcome mean_return median_return p10_return p90_return mean_excess_return mean_favorable_excursion mean_adverse_excursion mean_gap_recovered_fraction hit_rate_target hit_rate_target_missing_as_miss".split()


@plan("gap_study_flagship", f"""SELECT period, observation_label, metric_name, value FROM (SELECT period, observation_label, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in MEASURES)} FROM ({oracle.summary('obs_gap', 'period, observation_label')}) WHERE period <> 'test')
    UNPIVOT (value FOR metric_name IN ({', '.join(MEASURES)}))""")  # fmt: skip
def _(t):
    """Candidates, screen, outcomes and metrics end to end; test-period events are observed, not reported."""
    reported = t.obs_gap.filter("period <> 'test'")
    return studies.tidy(studies.summarize(reported, ["period", "observation_label"]), ["period", "observation_label"])


OPEN_OBS = ["instrument_id", "event_date", "observation_label", "outcome_status", "checkpoint_price", "checkpoint_bar_volume", "first_bar_close", "first_bar_volume", "max_high", "min_low", "bars_through_checkpoint", "zero_volume_bars", "benchmark_price", "hourly_close", "hourly_matches_5min", "reached_target_at_checkpoint", "reached_target_from_first_bar"]


@plan("opening_observations", _sql(OPEN_OBS, [*OUTCOMES, "return_from_first_bar"], "obs_open"))
def _(t):
    return _out(t.obs_open, OPEN_OBS, [*OUTCOMES, "return_from_first_bar"])


_OK = "outcome_status = 'evaluable'"
OPENING_EXTRA = f"""round(avg(return_from_first_bar) FILTER (WHERE {_OK}), 6) AS mean_return_from_first_bar,
    round(CASE WHEN count(*) FILTER (WHERE {_OK} AND return_from_first_bar IS NOT NULL) > 0 THEN count(*) FILTER (WHERE {_OK} AND reached_target_from_first_bar) / count(*) FILTER (WHERE {_OK} AND return_from_first_bar IS NOT NULL) END, 6) AS hit_rate_from_first_bar,
    round(CASE WHEN sum(bars_through_checkpoint) FILTER (WHERE {_OK}) > 0 THEN sum(zero_volume_bars) FILTER (WHERE {_OK}) / CAST(sum(bars_through_checkpoint) FILTER (WHERE {_OK}) AS DOUBLE) END, 6) AS zero_volume_share,
    round(CASE WHEN count(*) FILTER (WHERE {_OK} AND hourly_matches_5min IS NOT NULL) > 0 THEN count(*) FILTER (WHERE {_OK} AND hourly_matches_5min) / count(*) FILTER (WHERE {_OK} AND hourly_matches_5min IS NOT NULL) END, 6) AS hourly_agreement_rate"""


@plan("opening_metrics", oracle.summary("obs_open", "period, observation_label").replace("\n      FROM obs_open", f", {OPENING_EXTRA}\n      FROM obs_open"))
def _(t):
    return studies.summarize(t.obs_open, ["period", "observation_label"], studies.opening_extra())


@plan("multiday_path", "SELECT g.instrument_id, g.event_date, CAST(g.horizon AS INTEGER) AS horizon, g.target_date, p.max_high, p.min_low, CAST(p.sessions_observed AS BIGINT) AS sessions_observed FROM multi_grid g LEFT JOIN multi_path p ON p.instrument_id = g.instrument_id AND p.event_date = g.event_date AND p.horizon = g.horizon")
def _(t):
    return studies.multiday_path(t.cand_l, t.long, t.indexed).select("instrument_id", "event_date", "horizon", "target_date", "max_high", "min_low", "sessions_observed")


MULTI_OBS = ["instrument_id", "event_date", "observation_label", "target_date", "outcome_status", "checkpoint_price", "max_high", "min_low", "benchmark_price", "asset_type", "reached_target_at_checkpoint", "touched_target"]


@plan("multiday_observations", _sql(MULTI_OBS, OUTCOMES, "obs_multi"))
def _(t):
    return _out(t.obs_multi, MULTI_OBS, OUTCOMES)


FLAGGED = f"(SELECT *, {REGIME} AS market_regime, {TREND} AS market_trend FROM obs_multi)"


MEASURED = ["outcome_status", "measured_return", "excess_return", "max_favorable_excursion", "max_adverse_excursion", "gap_recovered_fraction", "reached_target_at_checkpoint"]


@plan("multiday_metrics", " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {value} AS member, * EXCLUDE ({exclude}) FROM ({oracle.summary(FLAGGED, keys)})"
    for name, value, keys, exclude in (("all", "'all'", "period, observation_label", "none_"), ("asset_type", "asset_type", "period, observation_label, asset_type", "asset_type"), ("market_regime", "market_regime", "period, observation_label, market_regime", "market_regime"), ("market_trend", "market_trend", "period, observation_label, market_trend", "market_trend"))
).replace(" EXCLUDE (none_)", ""))
def _(t):
    """Four groupings at once: a row stands under each of its members."""
    rows = t.obs_multi.withColumns({"market_regime": exprs.market_regime(F.col("benchmark_realized_vol"), S.STRESS), "market_trend": exprs.market_trend(F.col("benchmark_prior_window_return"))})
    rows = keep(rows.select("period", "observation_label", "asset_type", "market_regime", "market_trend", *MEASURED))
    members = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("member"))]
    members += [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("member")) for c in ("asset_type", "market_regime", "market_trend")]
    rows = rows.withColumn("of", F.explode(F.array(*members))).withColumns({"dimension": F.col("of.dimension"), "member": F.col("of.member")})
    keys = ["dimension", "member", "period", "observation_label"]
    return studies.summarize(rows, keys).select(*keys, *MEASURES)


@plan("events_by_year", "SELECT period, CAST(year(event_date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS events FROM (SELECT DISTINCT instrument_id, event_date, period FROM obs_multi) GROUP BY 1, 2")
def _(t):
    unique = t.obs_multi.select("instrument_id", "event_date", "period").distinct()
    return unique.groupBy("period", F.year("event_date").alias("year")).agg(F.count("*").alias("events"))


@plan("lookback_complete", "SELECT * FROM complete")
def _(t):
    return t.complete


@plan("eligibility_audit", "SELECT * FROM audit")
def _(t):
    return t.audit


@plan("eligibility_counts", "SELECT eligibility, CAST(count(*) AS BIGINT) AS events FROM audit GROUP BY 1")
def _(t):
    return t.audit.groupBy("eligibility").agg(F.count("*").alias("events"))


@plan("candidate_contract", "SELECT CAST(count(*) FILTER (WHERE instrument_id IS NULL OR event_date IS NULL) AS BIGINT) AS null_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated_events, CAST(coalesce(sum(u), 0) AS BIGINT) AS missing_decision_ts, CAST(coalesce(sum(r), 0) AS BIGINT) AS reversed_lookbacks, CAST(coalesce(sum(l), 0) AS BIGINT) AS lookback_not_before_event FROM (SELECT instrument_id, event_date, count(*) AS n, count(*) FILTER (WHERE decision_ts IS NULL) AS u, count(*) FILTER (WHERE lookback_start_date > prior_date) AS r, count(*) FILTER (WHERE prior_date >= event_date) AS l FROM cand GROUP BY 1, 2)")
def _(t):
    return events.candidate_contract(t.cand)


@plan("selection_contract", "SELECT CAST(0 AS BIGINT) AS not_candidates, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS repeated, CAST(count(*) AS BIGINT) AS not_selected FROM cand c WHERE NOT EXISTS (SELECT 1 FROM chosen s WHERE s.instrument_id = c.instrument_id AND s.event_date = c.event_date)")
def _(t):
    return events.selection_contract(t.cand, t.chosen)


@plan("observation_contract", "SELECT CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS missing_events, CAST(count(*) FILTER (WHERE s IS NULL) AS BIGINT) AS extra_events, CAST(count(*) FILTER (WHERE n <> 7 OR d <> 7) AS BIGINT) AS wrong_label_counts FROM (SELECT instrument_id, event_date, 1 AS s FROM chosen) FULL JOIN (SELECT instrument_id, event_date, count(*) AS n, count(DISTINCT observation_label) AS d FROM obs_gap GROUP BY 1, 2) USING (instrument_id, event_date)")
def _(t):
    return events.observation_contract(t.chosen, t.obs_gap, 7)


@plan("event_funnel", """SELECT 'candidates' AS stage, CAST(count(*) AS BIGINT) AS events FROM cand UNION ALL SELECT 'eligible', CAST(count(*) AS BIGINT) FROM audit WHERE eligibility = 'eligible' UNION ALL SELECT 'selected', CAST(count(*) AS BIGINT) FROM chosen
    UNION ALL SELECT 'any_missing_outcome', CAST(count(*) FILTER (WHERE m) AS BIGINT) FROM (SELECT bool_or(outcome_status = 'missing_outcome') AS m FROM obs_gap GROUP BY instrument_id, event_date)
    UNION ALL SELECT 'fully_evaluable', CAST(count(*) FILTER (WHERE NOT m) AS BIGINT) FROM (SELECT bool_or(outcome_status = 'missing_outcome') AS m FROM obs_gap GROUP BY instrument_id, event_date)""")  # fmt: skip
def _(t):
    return events.event_funnel(t.cand, t.audit.filter("eligibility = 'eligible'"), t.chosen, t.obs_gap)


@plan("load_observations", f"SELECT {EVENT}, observation_label, outcome_status, round(measured_return, 6) AS measured_return FROM obs_gap WHERE outcome_status = 'evaluable' AND period IN ('development', 'validation')")
def _(t):
    rows = t.obs_gap.filter("outcome_status = 'evaluable'").filter(F.col("period").isin("development", "validation"))
    return _out(rows, ["instrument_id", "event_date", "observation_label", "outcome_status"], ["measured_return"])


@plan("slice_liquidity_year", "SELECT CASE WHEN adv_dollars >= 1e7 THEN 'large' WHEN adv_dollars >= 2e6 THEN 'middle' ELSE 'small' END AS liquidity, CAST(year(event_date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS events, round(avg(measured_return), 6) AS mean_return, round(quantile_cont(measured_return, 0.5), 6) AS median_return FROM obs_multi WHERE observation_label = 'session_plus_0' AND outcome_status = 'evaluable' GROUP BY 1, 2")
def _(t):
    rows = t.scoped.withColumn("liquidity", exprs.liquidity(F.col("adv_dollars"), 1e7, 2e6))
    rows = rows.withColumn("year", F.year("event_date"))
    stats = rows.groupBy("liquidity", "year").agg(F.count("*").alias("events"), F.round(F.avg("measured_return"), 6).alias("mean_return"))
    return ranking.with_medians(stats, rows, ["liquidity", "year"]).withColumn("median_return", F.round("median_return", 6))


@plan("slice_regime", f"SELECT asset_type, market_regime, market_trend, CAST(count(*) AS BIGINT) AS events, round(avg(measured_return), 6) AS mean_return FROM {FLAGGED} WHERE outcome_status = 'evaluable' GROUP BY 1, 2, 3")
def _(t):
    rows = t.obs_multi.filter("outcome_status = 'evaluable'").withColumns({"market_regime": exprs.market_regime(F.col("benchmark_realized_vol"), S.STRESS), "market_trend": exprs.market_trend(F.col("benchmark_prior_window_return"))})
    return rows.groupBy("asset_type", "market_regime", "market_trend").agg(F.count("*").alias("events"), F.round(F.avg("measured_return"), 6).alias("mean_return"))


@plan("spike_event_study", """SELECT h AS checkpoint_hour, CAST(count(*) AS BIGINT) AS events, round(avg(r), 6) AS mean_return, round(quantile_cont(r, 0.5), 6) AS median_return FROM (
    SELECT v.ny_hour AS h, v.close / e.open - 1 AS r FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY date) AS prior_close FROM eod) e JOIN valid_h v ON v.instrument_id = e.instrument_id AND v.session_date = e.date
    WHERE e.prior_close > 0 AND e.open / e.prior_close - 1 <= -0.03 AND e.volume >= 3 AND v.ny_hour IN (10, 11, 12)) GROUP BY 1""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    days = t.eod.withColumn("prior_close", F.lag("close").over(Window.partitionBy("instrument_id").orderBy("date")))
    gap = exprs.ratio_minus_one(F.col("open"), F.col("prior_close"))
    found = days.filter((gap <= -0.03) & (F.col("volume") >= 3)).select("instrument_id", F.col("date").alias("session_date"), F.col("open").alias("event_open"))
    bars = studies.valid_hourly(t.hourly, t.sessions).filter(F.col("ny_hour").isin(10, 11, 12))
    rows = found.join(bars, ["instrument_id", "session_date"]).select(F.col("ny_hour").alias("checkpoint_hour"), (F.col("close") / F.col("event_open") - 1).alias("measured_return"))
    stats = rows.groupBy("checkpoint_hour").agg(F.count("*").alias("events"), F.round(F.avg("measured_return"), 6).alias("mean_return"))
    return ranking.with_medians(stats, rows, ["checkpoint_hour"]).withColumn("median_return", F.round("median_return", 6))


def _run_candidates(context):
    """The candidates of the coarse study, from what the first phase may read."""
    eod, hourly, schedule = context.read("eod"), context.read("intraday_1hour"), calendar.session_schedule(context.spark, EVENT_START, EVENT_END)
    density = features.hourly_density(eod, hourly, schedule, S.LOOKBACK)
    return studies.gap_candidates(features.eod_features(eod, S.LOOKBACK), schedule, density, S.BENCHMARK, S.LOOKBACK, S.GAP, 0.0, S.PERIODS)


def _run_observations(context, selected):
    schedule = calendar.session_schedule(context.spark, EVENT_START, EVENT_END)
    rows = studies.gap_observations(selected, context.read("intraday_1hour"), context.read("eod"), schedule, S.BENCHMARK, S.TARGET)
    keys = ["period", "observation_label"]
    tidy = studies.tidy(studies.summarize(rows, keys), keys)
    return rows, tidy.select("metric_name", "value", F.lit("").alias("unit"), F.create_map(F.lit("period"), F.col("period"), F.lit("observation_label"), F.col("observation_label")).alias("dimensions"))


def _published_run(t):
    """A warehouse of the query's own with a published two-phase run; (catalog, run id)."""
    store = own_warehouse(t, "run")
    store.publish("eod", t.eod)
    store.publish("intraday_1hour", t.hourly)
    store.put_metadata("aliases", t.event_aliases)
    study = phases.Study(
        "coarse", 1, ("eod", "intraday_1hour"), (), (phases.Lookback("eod", "lookback_start_date", "prior_date"),), phases.Gate(("duplicate_keys", "ohlc_invariants", "negative_values"), ("eod",), "2024-01-01", "2024-01-31"),
        _run_candidates, lambda context, eligible: studies.dense(eligible, hourly_density=S.DENSITY), _run_observations, (EVENT_START, EVENT_END),
    )
    runs = catalog.Catalog(t.spark, f"{store.root}/research")
    return runs, phases.run(study, store, runs, {"lookback": S.LOOKBACK})


_RUN_COUNTS = {
    "candidates": "count(*) FROM cand", "eligible": "count(*) FROM audit_all WHERE eligibility = 'eligible'", "identity_excluded": "count(*) FROM audit_all WHERE eligibility = 'identity_unresolved'",
    "calendar_excluded": "count(*) FROM audit_all WHERE eligibility = 'not_in_session'", "lookback_incomplete": "count(*) FROM audit_all WHERE eligibility = 'lookback_incomplete'", "selected": "count(*) FROM run_chosen",
    "evaluable": "count(*) FILTER (WHERE NOT m) FROM run_events", "missing_outcome": "count(*) FILTER (WHERE m) FROM run_events",
    "evaluable_observations": "count(*) FROM obs_run WHERE outcome_status = 'evaluable'", "missing_outcome_observations": "count(*) FROM obs_run WHERE outcome_status <> 'evaluable'",
}


@plan("run_audit", " UNION ALL ".join([*(f"SELECT 'event_audit.{k}' AS metric_name, CAST(NULL AS VARCHAR) AS severity, CAST(n AS DOUBLE) AS value FROM (SELECT {v.replace('count(*)', 'count(*)').replace(' FROM', ' AS n FROM', 1)})" for k, v in _RUN_COUNTS.items()), *(f"SELECT 'event_audit.quality_findings', '{s}', 0.0::DOUBLE" for s in ("info", "warning", "error"))]))
def _(t):
    """What a published run counted of itself: events of every step, outcomes and quality findings."""
    runs, run_id = _published_run(t)
    return runs.metrics(run_id).filter(F.col("metric_name").startswith(phases.RESERVED)).select("metric_name", F.col("dimensions")["severity"].alias("severity"), "value")


@plan("run_observations", f"SELECT {EVENT}, observation_label, outcome_status, round(measured_return, 6) AS measured_return FROM obs_run WHERE outcome_status = 'evaluable' AND period IN ('development', 'validation')")
def _(t):
    """Observations of a published run, loaded through its catalog."""
    runs, run_id = _published_run(t)
    rows = runs.load_observations([run_id]).filter("outcome_status = 'evaluable'").filter(F.col("period").isin("development", "validation"))
    return _out(rows, ["instrument_id", "event_date", "observation_label", "outcome_status"], ["measured_return"])


def _looked_back(labels: str, bars: str, first: str, last: str) -> str:
    return f"""SELECT e.instrument_id, e.event_date, CAST(count(DISTINCT l.ts) AS BIGINT) AS expected, CAST(count(DISTINCT CASE WHEN b.ts IS NOT NULL THEN l.ts END) AS BIGINT) AS matched,
        count(DISTINCT l.ts) > 0 AND count(DISTINCT l.ts) = count(DISTINCT CASE WHEN b.ts IS NOT NULL THEN l.ts END) AS complete
      FROM (SELECT DISTINCT instrument_id, event_date, {first} AS a, {last} AS z FROM cand) e LEFT JOIN {labels} l ON l.ts BETWEEN e.a AND e.z
      LEFT JOIN (SELECT DISTINCT instrument_id, ts FROM {bars}) b ON b.instrument_id = e.instrument_id AND b.ts = l.ts GROUP BY 1, 2"""


_HOURS_BACK, _MINUTES_BACK = ("hourly_lookback_start", "decision_ts - INTERVAL 1 HOUR"), ("decision_ts - INTERVAL 3 DAY", "decision_ts - INTERVAL 5 MINUTE")


@plan("lookback_complete_hourly", _looked_back("labels_hourly", "hourly", *_HOURS_BACK))
def _(t):
    """Whether every regular hour from the prior day to an hour before the decision has a bar."""
    spans = t.cand.select("instrument_id", "event_date", F.col("hourly_lookback_start").alias("a"), F.expr(_HOURS_BACK[1]).alias("z"))
    return events.lookback_complete(spans, t.hourly.select("instrument_id", F.col("ts").alias("label")), t.sessions, "a", "z", "intraday_1hour").drop("a", "b")


@plan("lookback_complete_5min", _looked_back("labels_five", "five", *_MINUTES_BACK))
def _(t):
    """Whether every regular five minutes of the three days before the decision has a bar."""
    spans = t.cand.select("instrument_id", "event_date", F.expr(_MINUTES_BACK[0]).alias("a"), F.expr(_MINUTES_BACK[1]).alias("z"))
    return events.lookback_complete(spans, t.five.select("instrument_id", F.col("ts").alias("label")), t.sessions, "a", "z", "intraday_5min").drop("a", "b")
