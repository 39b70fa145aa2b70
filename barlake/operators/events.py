"""The event-study engine: contracts, eligibility audit and observation audit.

A contract is one aggregate of violation counts, so checking it costs one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators.studies import EVENT


def candidate_contract(candidates: DataFrame) -> DataFrame:
    """Counts of null keys, repeated events, missing decision times and reversed lookbacks."""
    again = F.count("*") - 1
    per = candidates.groupBy(*EVENT).agg(
        again.alias("again"), F.count_if(F.col("decision_ts").isNull()).alias("undated"), F.count_if(F.col("lookback_start_date") > F.col("prior_date")).alias("reversed"),
        F.count_if(F.col("prior_date") >= F.col("event_date")).alias("late"),
    )
    null_key = F.col("instrument_id").isNull() | F.col("event_date").isNull()
    return per.agg(
        F.count_if(null_key).alias("null_keys"), F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_events"), F.coalesce(F.sum("undated"), F.lit(0)).alias("missing_decision_ts"),
        F.coalesce(F.sum("reversed"), F.lit(0)).alias("reversed_lookbacks"), F.coalesce(F.sum("late"), F.lit(0)).alias("lookback_not_before_event"),
    )


def selection_contract(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """How many selected rows are no candidate, or differ from theirs in a value; and how many stay out."""
    hashed = lambda df, name: df.groupBy(*EVENT).agg(F.min(F.xxhash64(*sorted(c for c in candidates.columns if c not in EVENT))).alias(name), F.count("*").alias(f"n_{name}"))
    both = hashed(candidates, "a").join(hashed(selected, "b"), EVENT, "full")
    return both.agg(
        F.count_if(F.col("a").isNull()).alias("not_candidates"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("changed"),
        F.count_if(F.col("n_b") > 1).alias("repeated"), F.count_if(F.col("b").isNull()).alias("not_selected"),
    )


def observation_contract(selected: DataFrame, observations: DataFrame, labels: int) -> DataFrame:
    """Events without observations, observations without events, and events with a wrong number of labels."""
    per = observations.groupBy(*EVENT).agg(F.count("*").alias("n"), F.countDistinct("observation_label").alias("distinct"))
    both = selected.select(*EVENT, F.lit(1).alias("s")).join(per, EVENT, "full")
    return both.agg(
        F.count_if(F.col("n").isNull()).alias("missing_events"), F.count_if(F.col("s").isNull()).alias("extra_events"),
        F.count_if((F.col("n") != labels) | (F.col("distinct") != labels)).alias("wrong_label_counts"),
    )


def _expected_upto(schedule: DataFrame, freq: str) -> DataFrame:
    """(day, before, first, n) for every day of the schedule's span: labels due before the day, its first one, and how many it has.

    A calendar of days, some hundreds a year, whatever the number of bars.
    """
    if freq == "eod":
        due = schedule.select(F.col("session_date").alias("day"), F.col("session_date").cast("timestamp_ntz").alias("first"), F.lit(1).alias("n"))
    else:
        due = calendar.expected_labels(schedule, freq).groupBy(F.col("session_date").alias("day")).agg(F.min("ts").alias("first"), F.count("*").cast("int").alias("n"))
    span = schedule.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", 400), F.date_add("b", 400))).alias("day")).join(due, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return days.withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))


def lookback_complete(events: DataFrame, bars: DataFrame, schedule: DataFrame, start: str, end: str, dataset: str = "eod") -> DataFrame:
    """(event, expected, matched, complete): labels due between two columns, both included, and those with a bar.

    ``bars`` is (instrument_id, label), ``label`` a day or a time. Labels due up to a time are a number that
    the calendar gives, so ``expected`` is the difference of two such numbers. Bars held up to a time are a
    running count in which both ends of every lookback stand as marks among the instrument's bars: one
    sort, and no event is multiplied by its labels.
    """
    freq = dataset.removeprefix("intraday_")
    step = 86_400 if freq == "eod" else 60 * calendar.BAR_MINUTES[freq]
    known = F.broadcast(_expected_upto(schedule, freq))
    past_first = lambda at: F.timestamp_diff("MICROSECOND", F.col("first"), F.col(at).cast("timestamp_ntz")) / (step * 1_000_000)

    def due(at: str, inclusive: bool) -> Column:
        """Labels due up to ``at``, or before it."""
        past = past_first(at)
        number = F.floor(past) + 1 if inclusive else F.ceil(past)
        return F.coalesce("before", F.lit(0)) + F.least(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)), F.coalesce("n", F.lit(0)))

    spans = events.select(*EVENT, F.col(start).alias("a"), F.col(end).alias("b")).distinct()
    rows = spans.withColumn("day", F.col("a").cast("date")).join(known, "day", "left").withColumn("due_before", due("a", False)).drop("day", "first", "n", "before")
    rows = rows.withColumn("day", F.col("b").cast("date")).join(known, "day", "left").withColumn("due", due("b", True)).drop("day", "first", "n", "before")
    expected = F.when(F.col("a") <= F.col("b"), F.col("due") - F.col("due_before")).otherwise(0)
    rows = rows.select(*EVENT, "a", "b", F.coalesce(expected, F.lit(0)).alias("expected"))

    # Bars on a due label, once each: the label's number grows from just before it to it.
    labels = bars.select("instrument_id", F.col("label").cast("timestamp_ntz").alias("at")).withColumn("day", F.col("at").cast("date")).join(known, "day")
    past = past_first("at")
    held = labels.filter((past >= 0) & (past < F.col("n")) & (past == F.floor(past))).select("instrument_id", "at").distinct()
    none = F.lit(None).cast("date")
    marks = rows.select("instrument_id", F.explode(F.array(*[F.struct(F.col(c).cast("timestamp_ntz").alias("at"), F.lit(place).alias("place")) for c, place in (("a", 0), ("b", 2))])).alias("m"), "event_date", "a", "b", "expected")
    marks = marks.select("instrument_id", "m.at", "m.place", "event_date", "a", "b", "expected")
    kinds = dict(rows.dtypes)
    line = held.select("instrument_id", "at", F.lit(1).alias("place"), none.alias("event_date"), F.lit(None).cast(kinds["a"]).alias("a"), F.lit(None).cast(kinds["b"]).alias("b"), F.lit(None).cast("bigint").alias("expected")).unionByName(marks)
    running = F.sum((F.col("place") == 1).cast("int")).over(Window.partitionBy("instrument_id").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0))
    ends = line.withColumn("held", running).filter("place <> 1")
    counts = ends.groupBy(*EVENT, "a", "b", "expected").agg((F.max(F.when(F.col("place") == 2, F.col("held"))) - F.max(F.when(F.col("place") == 0, F.col("held")))).alias("matched"))
    matched = F.greatest(F.coalesce("matched", F.lit(0)), F.lit(0)).cast("bigint")
    return counts.select(*EVENT, F.col("expected").cast("bigint").alias("expected"), matched.alias("matched")).withColumn("complete", (F.col("expected") > 0) & (F.col("expected") == F.col("matched")))


def eligibility_audit(candidates: DataFrame, aliases: DataFrame, schedule: DataFrame, complete: DataFrame) -> DataFrame:
    """One status for each event: identity comes before calendar, and that before the lookback."""
    spans = aliases.select(F.col("instrument_id").alias("owner"), "ticker", "start_date", "end_date")
    named = candidates.select(*EVENT).join(spans, (F.col("owner") == F.col("instrument_id")) & F.col("event_date").between(F.col("start_date"), F.col("end_date")), "left")
    identity = named.groupBy(*EVENT).agg(F.countDistinct("ticker").alias("tickers"))
    sessions = F.broadcast(schedule).select(F.col("session_date").alias("event_date"), "session_open", "session_close")
    timed = candidates.select(*EVENT, "decision_ts").join(sessions, "event_date", "left").groupBy(*EVENT).agg(
        F.count("session_open").alias("n"), F.max(F.col("decision_ts").between(F.col("session_open"), F.col("session_close"))).alias("inside")
    )
    rows = candidates.select(*EVENT).join(identity, EVENT, "left").join(timed, EVENT, "left").join(complete.select(*EVENT, "complete"), EVENT, "left")
    status = (
        F.when(F.col("tickers") != 1, "identity_unresolved").when((F.col("n") != 1) | ~F.coalesce("inside", F.lit(False)), "not_in_session")
        .when(~F.coalesce("complete", F.lit(False)), "lookback_incomplete").otherwise("eligible")
    )
    return rows.select(*EVENT, status.alias("eligibility"))


def event_funnel(candidates: DataFrame, eligible: DataFrame, selected: DataFrame, observations: DataFrame) -> DataFrame:
    """(stage, events): how many events each step kept, and how many of them miss any outcome."""
    missing = observations.groupBy(*EVENT).agg(F.bool_or(F.col("outcome_status") == "missing_outcome").alias("any_missing"))
    parts = [
        candidates.agg(F.count("*").alias("events")).withColumn("stage", F.lit("candidates")),
        eligible.agg(F.count("*").alias("events")).withColumn("stage", F.lit("eligible")),
        selected.agg(F.count("*").alias("events")).withColumn("stage", F.lit("selected")),
        missing.agg(F.count_if("any_missing").alias("events")).withColumn("stage", F.lit("any_missing_outcome")),
        missing.agg(F.count_if(~F.col("any_missing")).alias("events")).withColumn("stage", F.lit("fully_evaluable")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("stage", "events")
