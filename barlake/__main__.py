"""Commands over a warehouse: sql, status, quality, research-run, research-rank.

Exit code 1 says that a quality gate failed, 2 that the command could not be run.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import identity, quality, registry, runs
from barlake.operators.catalog import Catalog
from barlake.session import build_session
from barlake.sources.warehouse import DATASETS, Warehouse, time_column

SHOWN = 1000  # findings printed, those of the most rows first


def status(store: Warehouse) -> list[dict]:
    """Rows, instruments and dates of every dataset there is."""
    out = []
    for name in DATASETS:
        if store.exists(name):
            df = store.read(name)
            c = time_column(df)
            row = df.agg(F.count("*").alias("rows"), F.countDistinct("instrument_id").alias("instruments"), F.min(c).cast("date").alias("first"), F.max(c).cast("date").alias("last")).first()
            out.append({"dataset": name, **row.asDict()})
    return out


def findings(store: Warehouse, dataset: str, checks: list[str], start: str | None, end: str | None) -> tuple[list[dict], list[str]]:
    """The first findings of the declared checks on a dataset, and why the gate fails; the dataset is read once."""
    unknown = [c for c in checks if c not in quality.CHECKS or not quality.applicable(c, dataset)]
    if unknown:
        raise ValueError(f"no checks {unknown} of {dataset}")
    bars = store.read(dataset, start=start, end=end)
    span = bars.agg(F.min(time_column(bars)).cast("date"), F.max(time_column(bars)).cast("date")).first()
    if span[0] is None:
        return [], []
    coverage = store.metadata("coverage").filter(F.col("dataset_key") == dataset) if "coverage" in store.metadata_names() else None
    found = quality.run_checks({dataset: bars}, calendar.session_schedule(store.spark, *span), checks, coverage).persist()
    try:
        shown = found.filter("findings > 0").orderBy(F.desc("findings"), "check", "instrument_id").limit(SHOWN).collect()
        return [r.asDict() for r in shown], quality.blocks(found, checks, [dataset])
    finally:
        found.unpersist()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("barlake")
    parser.add_argument("root", help="the warehouse's folder")
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("status")
    commands.add_parser("sql").add_argument("text")
    q = commands.add_parser("quality")
    q.add_argument("dataset", choices=list(DATASETS))
    q.add_argument("checks", nargs="*", help="all that apply, if none is named")
    q.add_argument("--start")
    q.add_argument("--end")
    r = commands.add_parser("research-run")
    r.add_argument("study")
    r.add_argument("--parameters", default="{}", help="JSON")
    k = commands.add_parser("research-rank")
    k.add_argument("runs", nargs="+")
    k.add_argument("--checkpoint", required=True)
    k.add_argument("--window", action="append", required=True, help="select from:select to:evaluate from:evaluate to")
    a = parser.parse_args(arguments)
    try:
        spark = build_session("barlake", a.master)
        store, catalog = Warehouse(spark, a.root), Catalog(spark, f"{a.root}/research")
        if a.command == "status":
            for row in status(store):
                print(json.dumps(row, default=str))
        elif a.command == "sql":
            store.sql(a.text).show(1000, truncate=False)
        elif a.command == "quality":
            rows, blocking = findings(store, a.dataset, a.checks or [c for c in quality.CHECKS if quality.applicable(c, a.dataset)], a.start, a.end)
            for row in rows:
                print(json.dumps(row, default=str))
            for reason in blocking:
                print(reason, file=sys.stderr)
            return int(bool(blocking))
        elif a.command == "research-run":
            print(registry.dispatch(a.study, store, catalog, json.loads(a.parameters)))
        else:
            windows = [(w, *map(date.fromisoformat, w.split(":"))) for w in a.window]
            print("\n".join(runs.rank(catalog, a.runs, a.checkpoint, windows, identity.latest_alias(store.metadata("aliases")))))
    except Exception as problem:
        print(f"{type(problem).__name__}: {problem}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
