"""Two-pass propensity ranking and study comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import ranking
from barlake.plans.oracle import scores
from barlake.plans.registry import plan

SCORE = "pair, instrument_id, events, hits, round(hit_rate, 6) AS hit_rate, round(shrunk_hit_rate, 6) AS shrunk_hit_rate, round(lift, 6) AS lift, round(median_return, 6) AS median_return, round(mean_excess_return, 6) AS mean_excess_return"
ROUNDED = "hit_rate shrunk_hit_rate lift median_return mean_excess_return".split()


def _out(df, columns, rounded):
    return df.select(*columns, *[F.round(c, 6).alias(c) for c in rounded])


@plan("propensity_scope", "SELECT instrument_id, event_date, period, round(measured_return, 6) AS measured_return, round(excess_return, 6) AS excess_return, reached_target_at_checkpoint FROM scoped")
def _(t):
    return _out(t.scoped, ["instrument_id", "event_date", "period", "reached_target_at_checkpoint"], ["measured_return", "excess_return"])


@plan("propensity_walk_forward", "SELECT * FROM pairs")
def _(t):
    return t.pairs


@plan("propensity_select", f"SELECT {SCORE}, selected, CAST(row_number() OVER (PARTITION BY pair ORDER BY selected DESC, shrunk_hit_rate DESC, events DESC, instrument_id) AS INTEGER) AS rank FROM ranked")
def _(t):
    return _out(ranking.ranks(t.ranked), ["pair", "instrument_id", "events", "hits", "selected", "rank"], ROUNDED)


@plan("propensity_evaluate", f"SELECT {SCORE} FROM evaluated")
def _(t):
    return _out(t.evaluated, ["pair", "instrument_id", "events", "hits"], ROUNDED)


RATES = "round(candidate_hits / nullif(candidate_events, 0), 6) AS candidate_hit_rate, round(baseline_hits / nullif(baseline_events, 0), 6) AS baseline_hit_rate, round(candidate_hits / nullif(candidate_events, 0) - baseline_hits / nullif(baseline_events, 0), 6) AS lift"


@plan("propensity_two_pass", f"SELECT *, {RATES} FROM two_pass")
def _(t):
    return _out(t.two_pass, "pair baseline_events baseline_hits candidates with_events above_baseline candidate_events candidate_hits".split(), ["candidate_hit_rate", "baseline_hit_rate", "lift"])


@plan("propensity_pooled", f"SELECT *, {RATES} FROM (SELECT CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(candidate_events) AS BIGINT) AS candidate_events, CAST(sum(candidate_hits) AS BIGINT) AS candidate_hits, CAST(sum(baseline_events) AS BIGINT) AS baseline_events, CAST(sum(baseline_hits) AS BIGINT) AS baseline_hits, CAST(count(*) AS BIGINT) AS pairs FROM two_pass)")
def _(t):
    return _out(ranking.pooled(t.two_pass), "candidates candidate_events candidate_hits baseline_events baseline_hits pairs".split(), ["candidate_hit_rate", "baseline_hit_rate", "lift"])


def _groups(which: str) -> str:
    rows = f"(SELECT r.*, g.\"group\" FROM in_{which} r LEFT JOIN tags g ON g.instrument_id = r.instrument_id)"
    cast = "events, hits, instruments, round(hit_rate, 6) AS hit_rate, round(shrunk_hit_rate, 6) AS shrunk_hit_rate, round(lift, 6) AS lift, round(median_return, 6) AS median_return"
    return f"SELECT pair, \"group\", '{which}' AS pass, {cast} FROM ({scores(rows, chr(34) + 'group' + chr(34))}) WHERE \"group\" IS NOT NULL"


@plan("propensity_groups", f"{_groups('select')} UNION ALL {_groups('eval')}")
def _(t):
    return _out(ranking.groups(t.scoped, t.pairs, t.tags), ["pair", "group", "pass", "events", "hits", "instruments"], ["hit_rate", "shrunk_hit_rate", "lift", "median_return"])


#: hourly checkpoints known at the time of a five-minute checkpoint
LABELS = [(f"{h + 1:02d}:00_close_of_{h:02d}:00_bar", f"{h + 1:02d}:00_close_of_5min_bar") for h in range(10, 15)]


@plan("compare_agreement", f"""SELECT observation_label, CAST(count(*) AS BIGINT) AS pairs, round(count(*) FILTER (WHERE d <= 1e-12) / count(*), 6) AS agreed_share, round(avg(d), 6) AS mean_abs_diff, round(max(d), 6) AS max_abs_diff FROM (
    SELECT a.observation_label, abs(a.measured_return - b.measured_return) AS d FROM obs_gap a JOIN (VALUES {", ".join(map(str, LABELS))}) l(x, y) ON l.x = a.observation_label
    JOIN obs_open b ON b.instrument_id = a.instrument_id AND b.event_date = a.event_date AND b.observation_label = l.y WHERE a.measured_return IS NOT NULL AND b.measured_return IS NOT NULL) GROUP BY 1""")  # fmt: skip
def _(t):
    labels = t.spark.createDataFrame(LABELS, "observation_label string, other_label string")
    return _out(ranking.agreement(t.obs_gap, t.obs_open, labels), ["observation_label", "pairs"], ["agreed_share", "mean_abs_diff", "max_abs_diff"])


@plan("compare_opening", "SELECT observation_label, CAST(count(*) AS BIGINT) AS events, round(quantile_cont(measured_return, 0.5), 6) AS median_return, round(avg(measured_return), 6) AS mean_return, CAST(sum(bars_through_checkpoint) AS BIGINT) AS bars, CAST(sum(zero_volume_bars) AS BIGINT) AS zero_volume_bars FROM obs_open WHERE outcome_status = 'evaluable' GROUP BY 1")
def _(t):
    return _out(ranking.opening_window(t.obs_open, t.obs_gap), ["observation_label", "events", "bars", "zero_volume_bars"], ["median_return", "mean_return"])


@plan("compare_common", "SELECT CAST(count(*) FILTER (WHERE a = 1 AND b = 1) AS BIGINT) AS in_both, CAST(count(*) FILTER (WHERE b IS NULL) AS BIGINT) AS only_first, CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS only_second FROM (SELECT DISTINCT instrument_id, event_date, 1 AS a FROM obs_gap WHERE outcome_status = 'evaluable') FULL JOIN (SELECT DISTINCT instrument_id, event_date, 1 AS b FROM obs_open WHERE outcome_status = 'evaluable') USING (instrument_id, event_date)")
def _(t):
    ok = "outcome_status = 'evaluable'"
    return ranking.common(t.obs_gap.filter(ok), t.obs_open.filter(ok))
