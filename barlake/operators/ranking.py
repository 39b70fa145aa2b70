"""Two-pass propensity ranking and comparisons of studies, relational throughout.

Every pair of windows is handled in one pass: the pairs are a small frame joined by date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions import exprs
from barlake.operators import studies
from barlake.operators.studies import EVENT

PRIOR_STRENGTH, MIN_EVENTS, MIN_LIFT = 20, 10, 0.05
AGREED = 1e-12


def windows(spark: SparkSession, pairs: list[tuple[str, date, date, date, date]]) -> DataFrame:
    """(pair, select_start, select_end, eval_start, eval_end); evaluation starts after selection ends."""
    if any(p[2] >= p[3] for p in pairs):
        raise ValueError("an evaluation window must start after its selection window ends")
    return spark.createDataFrame(pairs, "pair string, select_start date, select_end date, eval_start date, eval_end date")


def walk_forward(scoped: DataFrame, years: int, excluded: tuple[str, ...] = ("test",)) -> DataFrame:
    """Yearly pairs: select on the ``years`` before, evaluate on the year; excluded periods aside."""
    y = scoped.filter(~F.col("period").isin(*excluded)).select(F.year("event_date").alias("year")).distinct()
    pairs = y.withColumn("first", F.min("year").over(Window.partitionBy(F.lit(0)))).filter(F.col("year") - years >= F.col("first"))  # a few years
    a = F.col("year") - years
    return pairs.select(
        F.concat_ws("-", a, F.col("year") - 1, F.col("year")).alias("pair"), F.make_date(a, F.lit(1), F.lit(1)).alias("select_start"), F.make_date(F.col("year") - 1, F.lit(12), F.lit(31)).alias("select_end"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("eval_start"), F.make_date("year", F.lit(12), F.lit(31)).alias("eval_end"),
    )


def scope(observations: DataFrame, checkpoint: str) -> DataFrame:
    """Evaluable observations of one checkpoint."""
    return observations.filter((F.col("observation_label") == checkpoint) & (F.col("outcome_status") == "evaluable"))


def in_windows(scoped: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """Observations in the selection or evaluation windows; windows stand as their days, an equality join."""
    days = pairs.withColumn("event_date", F.explode(F.sequence(f"{which}_start", f"{which}_end")))
    return scoped.join(F.broadcast(days), "event_date")


def scores(rows: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """Hits by key with shrinkage toward the pair's pooled rate: (..., baseline, shrunk_hit_rate, lift)."""
    stats = rows.groupBy("pair", *keys).agg(
        F.count("*").alias("events"), F.count_if("reached_target_at_checkpoint").alias("hits"), F.avg("excess_return").alias("mean_excess_return"), F.countDistinct("instrument_id").alias("instruments")
    )
    base = stats.groupBy("pair").agg((F.sum("hits") / F.sum("events")).alias("baseline"))
    joined = with_medians(stats, rows, ["pair", *keys]).join(F.broadcast(base), "pair")
    shrunk = (F.col("hits") + prior * F.col("baseline")) / (F.col("events") + prior)
    # Rounded before comparing, so that the order of additions decides nothing.
    return joined.withColumn("hit_rate", F.col("hits") / F.col("events")).withColumn("shrunk_hit_rate", F.round(shrunk, 9)).withColumn("lift", F.round(shrunk - F.col("baseline"), 9))


def with_medians(stats: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups' rows with their exact ``median_return``; no task holds a group's values."""
    found = studies.quantiles(rows, keys, "measured_return", {"median_return": 0.5})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return stats.join(found.select(*[F.col(k).alias(f"of_{k}") for k in keys], "median_return"), same, "left").drop(*[f"of_{k}" for k in keys])


def select_candidates(scoped: DataFrame, pairs: DataFrame, min_events: int = MIN_EVENTS, min_lift: float = MIN_LIFT, prior: int = PRIOR_STRENGTH) -> DataFrame:
    """Pass 1: every instrument of the selection window with its score, and whether it is chosen."""
    ranked = scores(in_windows(scoped, pairs, "select"), ["instrument_id"], prior)
    return ranked.withColumn("selected", (F.col("events") >= min_events) & (F.col("lift") >= min_lift))


def evaluate_candidates(scoped: DataFrame, pairs: DataFrame, candidates: DataFrame, prior: int = PRIOR_STRENGTH) -> DataFrame:
    """Pass 2: the chosen ones on the evaluation window; those without events have zero counts."""
    scored = scores(in_windows(scoped, pairs, "eval"), ["instrument_id"], prior)
    rows = candidates.select("pair", "instrument_id").join(scored, ["pair", "instrument_id"], "left")
    return rows.withColumns({"events": F.coalesce("events", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})


def evaluation_summary(scoped: DataFrame, pairs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row a pair: candidates, those above the baseline, their events and hits beside the baseline's."""
    base = in_windows(scoped, pairs, "eval").groupBy("pair").agg(F.count("*").alias("baseline_events"), F.count_if("reached_target_at_checkpoint").alias("baseline_hits"))
    own = evaluated.groupBy("pair").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("events") > 0).alias("with_events"), F.count_if(F.coalesce("lift", F.lit(-1.0)) > 0).alias("above_baseline"),
        F.sum("events").alias("candidate_events"), F.sum("hits").alias("candidate_hits"),
    )
    rows = base.join(own, "pair", "left").na.fill(0, ["candidates", "with_events", "above_baseline", "candidate_events", "candidate_hits"])
    rate = exprs.ratio(F.col("candidate_hits"), F.col("candidate_events"))
    return rows.withColumns({"candidate_hit_rate": rate, "baseline_hit_rate": exprs.ratio(F.col("baseline_hits"), F.col("baseline_events"))}).withColumn("lift", rate - F.col("baseline_hit_rate"))


def pooled(summary: DataFrame) -> DataFrame:
    """All pairs together, from exact hits."""
    s = summary.agg(*[F.sum(c).alias(c) for c in ("candidates", "candidate_events", "candidate_hits", "baseline_events", "baseline_hits")], F.count("*").alias("pairs"))
    a, b = exprs.ratio(F.col("candidate_hits"), F.col("candidate_events")), exprs.ratio(F.col("baseline_hits"), F.col("baseline_events"))
    return s.withColumns({"candidate_hit_rate": a, "baseline_hit_rate": b, "lift": a - b})


def groups(scoped: DataFrame, pairs: DataFrame, tags: DataFrame, prior: int = PRIOR_STRENGTH) -> DataFrame:
    """Each tagged group on both windows, against the baseline of all instruments."""
    out = None
    for which in ("select", "eval"):
        rows = in_windows(scoped, pairs, which).join(tags, "instrument_id", "left")
        part = scores(rows, ["group"], prior).filter("group IS NOT NULL").withColumn("pass", F.lit(which))
        out = part if out is None else out.unionByName(part)
    return out


def agreement(a: DataFrame, b: DataFrame, labels: DataFrame) -> DataFrame:
    """Same events and paired labels of two studies: how their returns differ, by label."""
    left = a.join(F.broadcast(labels), "observation_label").select(*EVENT, "observation_label", "other_label", F.col("measured_return").alias("ra"))
    right = b.select(*EVENT, F.col("observation_label").alias("other_label"), F.col("measured_return").alias("rb"))
    both = left.join(right, [*EVENT, "other_label"]).filter("ra IS NOT NULL AND rb IS NOT NULL").withColumn("diff", F.abs(F.col("ra") - F.col("rb")))
    return both.groupBy("observation_label").agg(F.count("*").alias("pairs"), (F.count_if(F.col("diff") <= AGREED) / F.count("*")).alias("agreed_share"), F.avg("diff").alias("mean_abs_diff"), F.max("diff").alias("max_abs_diff"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(in_both, only_first, only_second) of two studies' events."""
    both = a.select(*EVENT).distinct().withColumn("a", F.lit(1)).join(b.select(*EVENT).distinct().withColumn("b", F.lit(1)), EVENT, "full")
    return both.agg(F.count_if(F.expr("a IS NOT NULL AND b IS NOT NULL")).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


def opening_window(opening: DataFrame, events: DataFrame) -> DataFrame:
    """Returns and traded bars of the opening checkpoints, for events both studies have."""
    rows = opening.join(events.select(*EVENT).distinct(), EVENT, "left_semi").filter("outcome_status = 'evaluable'")
    stats = rows.groupBy("observation_label").agg(
        F.count("*").alias("events"), F.avg("measured_return").alias("mean_return"), F.sum("bars_through_checkpoint").alias("bars"), F.sum("zero_volume_bars").alias("zero_volume_bars")
    )
    return with_medians(stats, rows, ["observation_label"])


def write_two_pass(path: str, candidates: DataFrame, evaluated: DataFrame, groups: DataFrame | None = None, form: str = "parquet") -> list[str]:
    """Write the three tables of all window pairs beside one another; returns their paths.

    The evaluation is at ``path``, the others at ``path-candidates`` and ``path-groups``; each keeps its
    pair as ``window``. Tables without rows of groups are not written.
    """
    if form not in ("parquet", "csv"):
        raise ValueError("the form is parquet or csv")
    out = []
    for name, df in (("", evaluated), ("-candidates", candidates), ("-groups", groups)):
        if df is None or (name == "-groups" and df.isEmpty()):
            continue
        writer = df.withColumnRenamed("pair", "window").write.mode("overwrite")
        (writer.parquet if form == "parquet" else writer.option("header", True).csv)(path + name)
        out.append(path + name)
    return out


def render_two_pass(summary: DataFrame, candidates: DataFrame, evaluated: DataFrame, names: DataFrame, top: int = 25) -> list[str]:
    """Lines of text: the pooled rates, and for each window pair its ``top`` candidates by evaluation.

    ``names`` is (instrument_id, ticker). Only what is printed is collected.
    """
    percent = lambda x: "n/a" if x is None else f"{x:.1%}"
    total = pooled(summary).first()
    pairs = summary.orderBy("pair").collect()  # one row for each pair of windows
    lines = [
        f"{len(pairs)} window pairs, {sum((p.lift or 0) > 0 for p in pairs)} with a lift on evaluation",
        f"pooled: candidates {percent(total.candidate_hit_rate)}, baseline {percent(total.baseline_hit_rate)}, lift {percent(total.lift)}, {total.candidate_events or 0} events",
    ]
    before = candidates.filter("selected").select("pair", "instrument_id", F.col("events").alias("before"), F.col("hit_rate").alias("rate_before"))
    rows = evaluated.join(before, ["pair", "instrument_id"]).join(names, "instrument_id", "left")
    order = Window.partitionBy("pair").orderBy(F.desc_nulls_last("shrunk_hit_rate"), F.desc("events"), "instrument_id")
    shown = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).orderBy("pair", "place").collect()
    for p in pairs:
        lines += ["", f"{p.pair}: {p.candidates} candidates, {p.above_baseline} above the baseline of {percent(p.baseline_hit_rate)}; hit rate {percent(p.candidate_hit_rate)} on {p.candidate_events} events"]
        lines.append(f"  {'ticker':10}{'n':>6}{'rate':>8}{'n':>6}{'rate':>8}{'shrunk':>8}{'lift':>8}")
        for r in (r for r in shown if r.pair == p.pair):
            lines.append(f"  {r.ticker or r.instrument_id:10}{r.before:6d}{percent(r.rate_before):>8}{r.events:6d}{percent(r.hit_rate):>8}{percent(r.shrunk_hit_rate):>8}{percent(r.lift):>8}")
    return lines


def walk_order() -> list:
    return [F.desc("selected"), F.desc("shrunk_hit_rate"), F.desc("events"), F.col("instrument_id")]


def ranks(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(*walk_order())))
