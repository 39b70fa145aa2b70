"""Event studies in two phases: events are chosen, audited and frozen before any outcome can be read.

A study names the datasets that selection may read and those that only outcomes may. The run pins what
the warehouse holds at its start; every later read sees that. In the first phase a context opens the
selection datasets alone, and reading another one is an error. Candidates are written, audited, put
through the quality gate and selected; the selected events are written too. Only then does a second
context open the outcome datasets, and observations are made for the events read back from that table.

What breaks a contract is counted while a table is written. Any breach, and a failed gate, ends the run:
its folder keeps a failed record and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import events, quality
from barlake.operators.catalog import Catalog, Draft, RunError, canonical_json, written
from barlake.operators.studies import EVENT
from barlake.sources.warehouse import Snapshot, Warehouse

RESERVED = "event_audit."
RUNNER = "_event_runner"
STATUSES = ("evaluable", "missing_outcome")
METRICS = "metric_name string, value double, unit string, dimensions map<string,string>"
BAR_MINUTES = {"intraday_1hour": 60, "intraday_5min": 5}


class Sealed(RunError):
    """A dataset was read that the phase doesn't open."""


class ContractError(RunError):
    """Candidates, selected events, observations or metrics break what a study promises."""


class GateError(RunError):
    """A declared quality check found something severe or did not run."""


@dataclass(frozen=True)
class Lookback:
    """Bars that an event relies on: every expected one of the dataset between two columns of the candidate, both included."""

    dataset: str
    start: str
    end: str


@dataclass(frozen=True)
class Gate:
    """Quality checks that block a run, over the candidates' instruments and the dates."""

    checks: tuple[str, ...]
    datasets: tuple[str, ...]
    start: str
    end: str


class Context:
    """What a phase may read, as it was when the run began."""

    def __init__(self, pinned: Snapshot, opened: Sequence[str], parameters: Mapping):
        self.pinned, self.opened, self.parameters, self.spark = pinned, tuple(opened), parameters, pinned.spark

    def read(self, dataset: str, ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        if dataset not in self.opened:
            raise Sealed(f"{dataset} is not open in this phase; {', '.join(self.opened) or 'nothing'} is")
        return self.pinned.read(dataset, ids, start, end)

    def metadata(self, name: str) -> DataFrame:
        return self.pinned.metadata(name)

    def has_metadata(self, name: str) -> bool:
        return name in self.pinned.versions


@dataclass(frozen=True)
class Study:
    """A study's declarations and its three steps.

    ``candidates(context)`` gives rows with instrument_id, event_date and decision_ts; ``select(context, eligible)``
    some of the eligible rows, unchanged; ``observe(context, selected)`` observations of every selected event, with
    observation_label and outcome_status, and metrics (metric_name, value, unit, dimensions).
    """

    name: str
    version: int
    selection: tuple[str, ...]
    outcome: tuple[str, ...]
    lookbacks: tuple[Lookback, ...]
    gate: Gate
    candidates: Callable[[Context], DataFrame]
    select: Callable[[Context, DataFrame], DataFrame]
    observe: Callable[[Context, DataFrame], tuple[DataFrame, DataFrame]]
    schedule: tuple = field(default=())  # first and last day of the sessions that lookbacks and decisions may touch


def run(study: Study, store: Warehouse, catalog: Catalog, parameters: Mapping) -> str:
    """Run a study and publish it; returns the run's id."""
    if RUNNER in parameters:
        raise ValueError(f"{RUNNER} is the runner's own parameter")
    every = tuple(dict.fromkeys((*study.selection, *study.outcome)))
    unknown = [x.dataset for x in study.lookbacks if x.dataset not in study.selection]
    if not study.selection or unknown or not set(study.gate.datasets) <= set(every) or not set(study.gate.checks) <= set(quality.CHECKS):
        raise ValueError(f"{study.name}: lookbacks name selection datasets, and the gate known checks and datasets")
    declared = dict(parameters) | {RUNNER: {
        "selection": list(study.selection), "outcome": list(study.outcome), "lookbacks": [[x.dataset, x.start, x.end] for x in study.lookbacks],
        "gate": {"checks": list(study.gate.checks), "datasets": list(study.gate.datasets), "start": study.gate.start, "end": study.gate.end},
    }}
    pinned = store.pin(every)
    with catalog.publication(study.name, study.version, declared) as draft:
        catalog.put_inputs(draft, pinned, declared, {name: pinned.metadata(name) for name in pinned.versions})
        first = Context(pinned, study.selection, parameters)
        audited, counts = _audited(study, first, draft)
        findings = _gate(study, pinned, audited, draft)
        selected, counts["selected"] = _frozen(study, first, audited, draft)
        second = Context(pinned, every, parameters)
        observations, metrics = study.observe(second, selected)
        counts |= _observed(selected, observations, draft)
        _metrics(metrics, counts, findings, draft)
    return draft.run_id


def _fail(problems: Mapping[str, int], what: str) -> None:
    broken = {name: int(n) for name, n in problems.items() if n}
    if broken:
        raise ContractError(f"{what}: " + ", ".join(f"{n} {name.replace('_', ' ')}" for name, n in broken.items()))


def _types(df: DataFrame, wanted: Mapping[str, tuple[str, ...]], what: str) -> None:
    kinds = dict(df.dtypes)
    bad = [f"{c} ({kinds.get(c, 'absent')})" for c, kind in wanted.items() if kinds.get(c) not in kind]
    if bad:
        raise ContractError(f"{what} lack {', '.join(bad)}")


TIMES = ("timestamp_ntz", "timestamp")
KEY_TYPES = {"instrument_id": ("string",), "event_date": ("date",)}


def _audited(study: Study, context: Context, draft: Draft) -> tuple[DataFrame, dict[str, int]]:
    """Candidates with their eligibility, written; and how many there are of each status."""
    found = study.candidates(context)
    bounds = {c: ("date",) if x.dataset == "eod" else TIMES for x in study.lookbacks for c in (x.start, x.end)}
    _types(found, KEY_TYPES | {"decision_ts": TIMES} | bounds, "candidates")
    if "eligibility" in found.columns:
        raise ContractError("candidates have a column eligibility, which the audit adds")
    blank = F.coalesce((F.trim("instrument_id") == "") | (F.trim("instrument_id") != F.col("instrument_id")), F.lit(False))
    checks = {"null_keys": F.count_if(F.col("instrument_id").isNull() | F.col("event_date").isNull()), "blank_ids": F.count_if(blank), "missing_decision_times": F.count_if(F.col("decision_ts").isNull())}
    for i, x in enumerate(study.lookbacks):
        start, end = F.col(x.start), F.col(x.end)
        late = end >= F.col("event_date") if x.dataset == "eod" else end + F.expr(f"INTERVAL {BAR_MINUTES[x.dataset]} MINUTE") > F.col("decision_ts")
        checks[f"unbounded_lookbacks_{i}"] = F.count_if(start.isNull() | end.isNull())
        checks[f"reversed_or_late_lookbacks_{i}"] = F.count_if((start > end) | late)
    found, seen = written(found, f"{draft.folder}/_candidates", **checks)
    n = seen.pop("rows")
    _fail(seen, "candidates")

    schedule = calendar.session_schedule(context.spark, *study.schedule)
    complete = found.select(*EVENT).distinct().withColumns({"complete": F.lit(True), "undue": F.lit(False)})
    for x in study.lookbacks:
        bars = context.read(x.dataset).select("instrument_id", F.col("date" if x.dataset == "eod" else "ts").alias("label"))
        one = events.lookback_complete(found, bars, schedule, x.start, x.end, x.dataset).select(*EVENT, F.col("complete").alias("one"), (F.col("expected") == 0).alias("none"))
        complete = complete.join(one, EVENT).select(*EVENT, (F.col("complete") & F.col("one")).alias("complete"), (F.col("undue") | F.col("none")).alias("undue"))
    status = events.eligibility_audit(found, context.metadata("aliases"), schedule, complete)
    status = status.join(complete.select(*EVENT, "undue"), EVENT).groupBy(*EVENT).agg(F.min("eligibility").alias("eligibility"), F.count("*").alias("n"), F.bool_or("undue").alias("undue"))
    audited = found.join(status, EVENT)
    of = lambda name: F.count_if(F.col("eligibility") == name)
    kept = audited.withColumn("again", F.col("n") > 1)
    table, seen = written(
        kept.drop("n"), f"{draft.folder}/_audited", rows_of_repeated_events=F.count_if("again"), lookbacks_without_an_expected_bar=F.count_if(F.col("undue") & (F.col("eligibility") != "not_in_session")),
        eligible=of("eligible"), identity_excluded=of("identity_unresolved"), calendar_excluded=of("not_in_session"), lookback_incomplete=of("lookback_incomplete"),
    )
    _fail({k: seen[k] for k in ("rows_of_repeated_events", "lookbacks_without_an_expected_bar")}, "candidates")
    names = ("eligible", "identity_excluded", "calendar_excluded", "lookback_incomplete")
    return table.drop("again", "undue"), {"candidates": n} | {k: int(seen[k] or 0) for k in names}


def _gate(study: Study, pinned: Snapshot, audited: DataFrame, draft: Draft) -> DataFrame:
    """Findings of all checks on the candidates' instruments; a declared check that found anything severe ends the run."""
    ids = audited.select("instrument_id").distinct()
    first, last = study.schedule
    frames = {d: pinned.read(d, start=study.gate.start, end=study.gate.end).join(ids, "instrument_id", "left_semi") for d in study.gate.datasets}
    found = quality.run_checks(frames, calendar.session_schedule(pinned.spark, first, last), tuple(c for c in quality.CHECKS if c in study.gate.checks))
    table, _ = written(found, f"{draft.folder}/quality")
    blocking = quality.blocks(table, study.gate.checks, study.gate.datasets)
    if blocking:
        raise GateError(f"quality gate: {', '.join(blocking)}")
    return table


def _frozen(study: Study, context: Context, audited: DataFrame, draft: Draft) -> tuple[DataFrame, int]:
    """The selected events, each equal to its eligible candidate, written."""
    eligible = audited.filter("eligibility = 'eligible'").drop("eligibility")
    chosen = study.select(context, eligible)
    if sorted(chosen.dtypes) != sorted(eligible.dtypes):
        raise ContractError("selected events have other columns than the candidates")
    values = F.xxhash64(F.to_json(F.struct(*sorted(eligible.columns))))
    known = eligible.select(*EVENT, values.alias("audited"))
    rows = chosen.select(eligible.columns).withColumn("own", values).join(known, EVENT, "left")
    # A repeated event is counted by its rows less one; equal rows all stand beside the same candidate.
    again = rows.groupBy(*EVENT).agg(F.count("*").alias("n"), F.first("audited").alias("audited"), F.max((F.col("own") != F.col("audited")).cast("int")).alias("changed"))
    frozen = again.join(eligible, EVENT, "left")
    table, seen = written(
        frozen, f"{draft.folder}/_selected", events_that_are_not_eligible=F.count_if(F.col("audited").isNull()), changed_events=F.count_if(F.col("changed") == 1), repeated_events=F.count_if(F.col("n") > 1)
    )
    n = seen.pop("rows")
    _fail(seen, "selected events")
    return table.select(eligible.columns), int(n)


def _observed(selected: DataFrame, observations: DataFrame, draft: Draft) -> dict[str, int]:
    """Write the observations and one row for each event; every selected event has some, each label once."""
    _types(observations, KEY_TYPES | {"observation_label": ("string",), "outcome_status": ("string",)}, "observations")
    status = F.col("outcome_status")
    table, seen = written(
        observations, f"{draft.folder}/observations",
        null_or_blank_labels=F.count_if(F.col("observation_label").isNull() | (F.trim("observation_label") == "")), unknown_statuses=F.count_if(status.isNull() | ~status.isin(*STATUSES)),
        evaluable_observations=F.count_if(status == "evaluable"), missing_outcome_observations=F.count_if(status == "missing_outcome"),
    )
    _fail({k: seen[k] for k in ("null_or_blank_labels", "unknown_statuses")}, "observations")
    draft.record |= {"rows": int(seen["rows"]), "schema": json.loads(observations.schema.json())}
    per = table.groupBy(*EVENT).agg(F.count("*").alias("labels"), F.countDistinct("observation_label").alias("distinct_labels"), F.bool_or(F.col("outcome_status") == "missing_outcome").alias("any_missing"))
    both = selected.select(*EVENT, F.lit(True).alias("selected")).join(per, EVENT, "full")
    _, per_event = written(
        both, f"{draft.folder}/event_outcomes", dropped_events=F.count_if(F.col("labels").isNull()), events_that_were_not_selected=F.count_if(F.col("selected").isNull()),
        events_with_repeated_labels=F.count_if(F.col("labels") != F.col("distinct_labels")), evaluable=F.count_if(~F.col("any_missing")), missing_outcome=F.count_if("any_missing"),
    )
    _fail({k: per_event[k] for k in ("dropped_events", "events_that_were_not_selected", "events_with_repeated_labels")}, "observations")
    return {k: int(per_event[k] or 0) for k in ("evaluable", "missing_outcome")} | {k: int(seen[k] or 0) for k in ("evaluable_observations", "missing_outcome_observations")}


def _metrics(metrics: DataFrame, counts: Mapping[str, int], findings: DataFrame, draft: Draft) -> None:
    """Write the study's metrics and the run's own, whose names no study may use."""
    spark = metrics.sparkSession
    own = [(f"{RESERVED}{name}", float(n), "observations" if name.endswith("_observations") else "events", {}) for name, n in counts.items()]
    severities = {s: 0.0 for s in quality.SEVERITIES} | {r.severity: float(r.n) for r in findings.filter("findings > 0").groupBy("severity").agg(F.sum("findings").alias("n")).collect()}
    own += [(f"{RESERVED}quality_findings", n, "findings", {"severity": s}) for s, n in severities.items()]
    columns = [x.split()[0] for x in METRICS.split(", ")]
    shaped = metrics.select(columns).withColumn("reserved", F.col("metric_name").startswith(RESERVED))
    shaped = shaped.unionByName(spark.createDataFrame(own, METRICS).withColumn("reserved", F.lit(False)))
    _, seen = written(shaped, f"{draft.folder}/_metrics", reserved_metric_names=F.count_if("reserved"))
    _fail({"reserved_metric_names": seen["reserved_metric_names"]}, "metrics")
    written(spark.read.schema(shaped.schema).parquet(f"{draft.folder}/_metrics").drop("reserved"), f"{draft.folder}/metrics")
    draft.record |= {"counts": json.loads(canonical_json(dict(counts)))}
