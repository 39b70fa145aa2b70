"""Structural quality checks; each gives findings (check, severity, instrument_id, n, sample)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import calendar, exprs

SAMPLE = 10
ZERO_RUN = 5
#: severity and the datasets each check applies to
CHECKS = {
    "missing_expected_sessions": ("warning", ("eod",)),
    "duplicate_keys": ("error", ("eod", "intraday")),
    "ohlc_invariants": ("error", ("eod", "intraday")),
    "negative_values": ("error", ("eod", "intraday")),
    "zero_volume_runs": ("warning", ("eod", "intraday")),
    "split_sanity": ("error", ("eod",)),
    "off_session_intraday": ("warning", ("intraday",)),
    "coverage_delisting_summary": ("info", ("eod", "intraday")),
}
#: in the order of findings
DATASETS = ["eod", "intraday_1hour", "intraday_5min"]
SEVERE = ("warning", "error")
SEVERITIES = ("info", "warning", "error")
FINDINGS = "dataset_key string, check string, instrument_id string, severity string, findings long"
PRICES = ("open", "high", "low", "close")
DAILY = (*PRICES, "adj_open", "adj_high", "adj_low", "adj_close", "div_cash")


def numbered(rows: DataFrame, by: str, key: str = "instrument_id") -> DataFrame:
    """Rows with their place within the key, for ``sample``; the sort spills where a key has many."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(by)))


def sample(column: str) -> Column:
    """The first few values of ``numbered`` rows in order, as text; no more are collected."""
    first = F.collect_list(F.when(F.col("place") <= SAMPLE, F.struct("place", F.col(column).cast("string").alias("text"))))
    return F.array_join(F.transform(F.sort_array(first), lambda x: x["text"]), ",")


def scoped(bars: DataFrame, ids: list[str] | None = None, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Restrict to ids and inclusive dates; an empty list of ids keeps nothing."""
    if ids is not None:
        bars = bars.filter(F.col("instrument_id").isin(ids) if ids else F.lit(False))
    if start:
        bars = bars.filter(F.col(column).cast("date") >= F.lit(start).cast("date"))
    return bars.filter(F.col(column).cast("date") <= F.lit(end).cast("date")) if end else bars


def duplicate_keys(bars: DataFrame, key: str = "date") -> DataFrame:
    """Keys that repeat, the rows too many, and the first such keys."""
    groups = numbered(bars.groupBy("instrument_id", key).agg(F.count("*").alias("n")).filter("n > 1"), key)
    return groups.groupBy("instrument_id").agg(F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("extra_rows"), sample(key).alias("sample"))


def ohlc_invariants(bars: DataFrame) -> DataFrame:
    """Invalid raw and adjusted bars by instrument, both counted in one pass."""
    raw, adjusted = exprs.ohlc_invalid(), exprs.ohlc_invalid("adj_open", "adj_high", "adj_low", "adj_close")
    counts = bars.groupBy("instrument_id").agg(F.count_if(raw).alias("n_raw"), F.count_if(adjusted).alias("n_adjusted"))
    return counts.filter("n_raw + n_adjusted > 0")


def negative_values(bars: DataFrame) -> DataFrame:
    """Volumes unknown or below 0, and prices or dividends below 0."""
    low = F.lit(False)
    for c in ("open", "high", "low", "close", "adj_open", "adj_high", "adj_low", "adj_close", "div_cash"):
        low = low | F.coalesce(F.col(c) < 0, F.lit(False))
    bad = F.col("volume").isNull() | (F.col("volume") < 0)
    counts = bars.groupBy("instrument_id").agg(F.count_if(bad).alias("n_volume"), F.count_if(low).alias("n_value"))
    return counts.filter("n_volume + n_value > 0")


def split_sanity(bars: DataFrame) -> DataFrame:
    """Split factors that are unknown, not finite or not positive."""
    s = F.col("split_factor")
    bad = numbered(bars.filter(s.isNull() | ~exprs.is_finite(s) | (s <= 0)), "date")
    return bad.groupBy("instrument_id").agg(F.count("*").alias("n"), sample("date").alias("sample"))


def _zero() -> Column:
    """Whether all copies of a bar have a known volume, and it is 0."""
    return (F.count("volume") == F.count("*")) & (F.min("volume") == 0) & (F.max("volume") == 0)


def _runs(bars: DataFrame, time: str, step: Column, within: list[str], shortest: int) -> DataFrame:
    """Runs of bars whose steps follow one another: their step less their place is the same number."""
    w = Window.partitionBy("instrument_id", *within).orderBy(time)
    runs = bars.withColumn("run", step - F.row_number().over(w))
    found = runs.groupBy("instrument_id", *within, "run").agg(F.min(time).alias(f"first_{time}"), F.max(time).alias(f"last_{time}"), F.count("*").alias("n"))
    return found.filter(F.col("n") >= shortest).drop("run")


def zero_volume_runs(bars: DataFrame, indexed: DataFrame, shortest: int = ZERO_RUN) -> DataFrame:
    """Runs of consecutive sessions without volume: (instrument_id, first_date, last_date, n_sessions).

    A day counts where all its rows have a known volume of 0; a day off the calendar counts nowhere.
    """
    days = bars.groupBy("instrument_id", "date").agg(_zero().alias("zero")).filter("zero")
    days = days.join(F.broadcast(indexed.select(F.col("session_date").alias("date"), "session_index")), "date")
    return _runs(days, "date", F.col("session_index"), [], shortest).withColumnRenamed("n", "n_sessions")


def zero_volume_bar_runs(bars: DataFrame, schedule: DataFrame, freq: str, shortest: int = ZERO_RUN) -> DataFrame:
    """Runs of regular intraday bars without volume, one step apart within a session.

    (instrument_id, session_date, first_ts, last_ts, n_bars); bars off the session's grid count nowhere.
    """
    regular = calendar.label_sessions(bars, schedule, freq).groupBy("instrument_id", "session_date", "ts").agg(_zero().alias("zero"), F.min("minutes_from_open").alias("minutes")).filter("zero")
    step = F.floor(F.col("minutes") / calendar.BAR_MINUTES[freq])
    return _runs(regular, "ts", step, ["session_date"], shortest).withColumnRenamed("n", "n_bars")


def clipped(coverage: DataFrame, ids: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Coverage within a scope: the selected ids' spans cut to the dates, those outside left out."""
    if ids is not None:
        coverage = coverage.filter(F.col("instrument_id").isin(ids) if ids else F.lit(False))
    if start:
        coverage = coverage.withColumn("first_date", F.greatest("first_date", F.lit(start).cast("date")))
    if end:
        coverage = coverage.withColumn("last_date", F.least("last_date", F.lit(end).cast("date")))
    return coverage.filter("first_date <= last_date")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings (dataset_key, check, instrument_id, severity, message) by dataset, check, id and severity."""
    place = lambda column, names: F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return findings.orderBy(place("dataset_key", DATASETS), place("check", list(CHECKS)), F.coalesce("instrument_id", F.lit("")), "severity", "message")


def missing_sessions(bars: DataFrame, coverage: DataFrame, schedule: DataFrame) -> DataFrame:
    """Sessions inside an instrument's coverage without a bar; spans explode to days, an equality."""
    days = coverage.select("instrument_id", F.explode(F.sequence("first_date", "last_date")).alias("date"))
    due = days.join(F.broadcast(schedule.select(F.col("session_date").alias("date"))), "date", "left_semi")
    gone = numbered(due.join(bars.select("instrument_id", "date"), ["instrument_id", "date"], "left_anti"), "date")
    return gone.groupBy("instrument_id").agg(F.count("*").alias("n"), sample("date").alias("sample"))


def off_session(bars: DataFrame, schedule: DataFrame, freq: str) -> DataFrame:
    """Intraday bars that are no whole regular bar of their session."""
    rows = bars.join(F.broadcast(schedule), exprs.utc_date(F.col("ts")) == schedule.session_date, "left")
    bad = rows.filter(~F.coalesce(calendar.aligned(freq), F.lit(False)))
    return bad.groupBy("instrument_id").agg(F.count("*").alias("n"))


def coverage_summary(bars: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each instrument's rows and span beside its coverage, and what disagrees."""
    held = bars.groupBy("instrument_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))
    both = held.join(coverage.select("instrument_id", "first_date", "last_date"), "instrument_id", "full")
    status = (
        F.when(F.col("n_rows").isNull(), "no_rows").when(F.col("first_date").isNull(), "orphan_rows")
        .when((F.col("first_bar") < F.col("first_date")) | (F.col("last_bar") > F.col("last_date")), "outside_coverage").otherwise("ok")
    )
    return both.withColumn("status", status).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def gate(counts: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    """(check, severity, findings, blocks): a declared check blocks if it found anything severe or did not run."""
    rows = counts.sparkSession.createDataFrame([(c, CHECKS[c][0], c in declared) for c in CHECKS], "check string, severity string, declared boolean")
    joined = F.broadcast(rows).join(counts, "check", "left")
    blocks = F.col("declared") & (F.col("findings").isNull() | ((F.col("findings") > 0) & F.col("severity").isin(*SEVERE)))
    return joined.select("check", "severity", F.coalesce("findings", F.lit(-1)).alias("findings"), blocks.alias("blocks"))


def applicable(check: str, dataset: str) -> bool:
    return dataset.split("_")[0] in CHECKS[check][1]


def run_checks(frames: Mapping[str, DataFrame], schedule: DataFrame, checks: Sequence[str] = tuple(CHECKS), coverage: DataFrame | None = None, shortest: int = ZERO_RUN) -> DataFrame:
    """FINDINGS of the checks by dataset and instrument, each dataset read once.

    A check that ran on a dataset has a row without instrument and with 0 findings, so that one that did not
    run shows. What is counted: keys that repeat; bars with disordered prices (raw and adjusted ones each);
    rows with a bad volume and rows with a value below 0; rows with a bad split; runs of at least ``shortest``
    sessions (bars within a session) without volume; bars that are no whole regular bar of a session;
    sessions within the coverage, or else between an instrument's first and last bar, without a bar; and
    coverage that disagrees with the bars (1 for an instrument).
    """
    out = None
    for dataset, bars in frames.items():
        wanted = [c for c in checks if applicable(c, dataset)]
        if wanted:
            found = _daily(bars, schedule, coverage, shortest) if dataset == "eod" else _intraday(bars, schedule, dataset.removeprefix("intraday_"), coverage, shortest)
            pairs = ", ".join(f"'{c}', CAST({c} AS BIGINT)" for c in wanted)
            rows = found.select("instrument_id", F.expr(f"stack({len(wanted)}, {pairs}) AS (check, findings)")).filter("findings > 0")
            ran = bars.sparkSession.createDataFrame([(None, c, 0) for c in wanted], "instrument_id string, check string, findings long")
            rows = rows.unionByName(ran).withColumn("dataset_key", F.lit(dataset))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no check applies to the datasets")
    severity = F.create_map(*[F.lit(x) for c, (s, _) in CHECKS.items() for x in (c, s)])
    return out.select("dataset_key", "check", "instrument_id", severity[F.col("check")].alias("severity"), "findings")


def _streaks(within: list[str], by: str, shortest: int) -> Column:
    """Whether a run of keys without volume reaches ``shortest`` at this one; steps of a run follow one another."""
    w = Window.partitionBy("instrument_id", *within).orderBy(by)
    full = F.sum(F.col("zero").cast("int")).over(w.rowsBetween(1 - shortest, 0)) == shortest
    reached = full & (F.col("step") - F.lag("step", shortest - 1).over(w) == shortest - 1) if shortest > 1 else F.col("zero")
    longer = F.lag("step", shortest).over(w)
    before = (F.sum(F.col("zero").cast("int")).over(w.rowsBetween(-shortest, 0)) == shortest + 1) & (F.col("step") - longer == shortest)
    return F.coalesce(reached & ~F.coalesce(before, F.lit(False)), F.lit(False))


def _counts(bars: DataFrame, key: str, prices: Sequence[str], **more: Column) -> DataFrame:
    """One row for each key, with what all its rows show."""
    low = F.lit(False)
    for c in prices:
        low = low | F.coalesce(F.col(c) < 0, F.lit(False))
    bad = F.col("volume").isNull() | (F.col("volume") < 0)
    return bars.groupBy("instrument_id", key).agg(
        F.count("*").alias("n"), F.count_if(exprs.ohlc_invalid()).alias("disordered"), F.count_if(bad).alias("bad_volumes"), F.count_if(low).alias("low_values"), _zero().alias("zero"), *[c.alias(name) for name, c in more.items()]
    )


def _daily(bars: DataFrame, schedule: DataFrame, coverage: DataFrame | None, shortest: int) -> DataFrame:
    adjusted, split = exprs.ohlc_invalid("adj_open", "adj_high", "adj_low", "adj_close"), F.col("split_factor")
    keys = _counts(bars, "date", DAILY, adjusted=F.count_if(adjusted), splits=F.count_if(split.isNull() | ~exprs.is_finite(split) | (split <= 0)))
    numbered = F.broadcast(calendar.with_index(schedule).select(F.col("session_date").alias("date"), F.col("session_index").alias("step")))
    # A day off the calendar stands in a partition of its own and breaks no run.
    keys = keys.join(numbered, "date", "left").withColumn("regular", F.col("step").isNotNull())
    keys = keys.withColumn("run", _streaks(["regular"], "date", shortest) & F.col("regular"))
    if coverage is not None:
        keys = keys.join(coverage.select("instrument_id", "first_date", "last_date"), "instrument_id", "full")
    else:
        keys = keys.withColumns({"first_date": F.min("date").over(Window.partitionBy("instrument_id")), "last_date": F.max("date").over(Window.partitionBy("instrument_id"))})
    inside = F.coalesce(F.col("regular") & F.col("date").between(F.col("first_date"), F.col("last_date")), F.lit(False))
    found = keys.groupBy("instrument_id").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum(F.col("disordered") + F.col("adjusted")).alias("ohlc_invariants"), F.sum(F.col("bad_volumes") + F.col("low_values")).alias("negative_values"),
        F.sum("splits").alias("split_sanity"), F.count_if("run").alias("zero_volume_runs"), F.count_if(inside).alias("held"), *_span("date"),
    )
    # Sessions up to a day are a number that the calendar gives.
    upto = calendar.sessions_upto(schedule)
    for c in ("first_date", "last_date"):
        found = found.join(F.broadcast(upto.select(F.col("day").alias(c), F.col("upto").alias(f"{c}_upto"), F.col("is_session").alias(f"{c}_session"))), c, "left")
    due = F.col("last_date_upto") - F.col("first_date_upto") + F.col("first_date_session").cast("int")
    return found.withColumn("missing_expected_sessions", F.greatest(due - F.col("held"), F.lit(0))).withColumn("coverage_delisting_summary", _disagrees(coverage))


def _intraday(bars: DataFrame, schedule: DataFrame, freq: str, coverage: DataFrame | None, shortest: int) -> DataFrame:
    placed = bars.join(F.broadcast(schedule), exprs.utc_date(F.col("ts")) == schedule.session_date, "left").withColumn("regular", F.coalesce(calendar.aligned(freq), F.lit(False)))
    minutes = exprs.minutes_between(F.col("session_open"), F.col("ts"))
    keys = _counts(placed, "ts", PRICES, off=F.count_if(~F.col("regular")), regular=F.bool_or("regular"), session_date=F.first("session_date"), step=F.first(F.floor(minutes / calendar.BAR_MINUTES[freq])))
    keys = keys.withColumn("run", _streaks(["session_date", "regular"], "ts", shortest) & F.col("regular"))
    if coverage is not None:
        keys = keys.join(coverage.select("instrument_id", "first_date", "last_date"), "instrument_id", "full")
    else:
        keys = keys.withColumns({"first_date": F.lit(None).cast("date"), "last_date": F.lit(None).cast("date")})
    found = keys.groupBy("instrument_id").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum("disordered").alias("ohlc_invariants"), F.sum(F.col("bad_volumes") + F.col("low_values")).alias("negative_values"),
        F.sum("off").alias("off_session_intraday"), F.count_if("run").alias("zero_volume_runs"), *_span("ts"),
    )
    return found.withColumn("coverage_delisting_summary", _disagrees(coverage))


def _span(key: str) -> list[Column]:
    return [F.min(F.col(key).cast("date")).alias("first_bar"), F.max(F.col(key).cast("date")).alias("last_bar"), F.first("first_date", ignorenulls=True).alias("first_date"), F.first("last_date", ignorenulls=True).alias("last_date")]


def _disagrees(coverage: DataFrame | None) -> Column:
    """Bars without coverage, coverage without bars, or bars outside it; 0 where no coverage is given."""
    if coverage is None:
        return F.lit(0)
    outside = (F.col("first_bar") < F.col("first_date")) | (F.col("last_bar") > F.col("last_date"))
    return (F.col("first_bar").isNull() | F.col("first_date").isNull() | outside).cast("int")


def blocks(findings: DataFrame, declared: Sequence[str], datasets: Sequence[str]) -> list[str]:
    """Why declared checks block: one that found anything severe, or that did not run on every dataset it applies to."""
    ran = {(r.dataset_key, r.check): r.n for r in findings.groupBy("dataset_key", "check").agg(F.sum("findings").alias("n")).collect()}  # a row for each check and dataset
    out = []
    for check in declared:
        due = [d for d in datasets if applicable(check, d)]
        if not due:
            out.append(f"{check} applies to none of the datasets")
        for d in due:
            if (d, check) not in ran:
                out.append(f"{check} did not run on {d}")
            elif ran[d, check] and CHECKS[check][0] in SEVERE:
                out.append(f"{check} found {ran[d, check]} on {d}")
    return out
