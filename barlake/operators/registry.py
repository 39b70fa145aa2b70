"""Named studies: their parameters checked and completed, their benchmark resolved, and their dispatch."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable, Mapping
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators import identity

LEAST_LOOKBACK = 6

_studies: dict[str, Callable] = {}


def normalize_parameters(given: Mapping, defaults: Mapping, study: str) -> dict:
    """The defaults with what is given, checked: any unknown name or value out of bounds is an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"{study} has no parameters {unknown}")
    p = {**defaults, **given}

    def require(ok: bool, text: str) -> None:
        if not ok:
            raise ValueError(f"{study}: {text}")

    start, end = (date.fromisoformat(str(p[k])) for k in ("start", "end"))
    require(start <= end, "start lies after end")
    require(float(p["gap_threshold"]) < 0, "a gap down is below 0")
    require(float(p["min_adv_dollars"]) >= 0, "the least volume is not negative")
    require(int(p["lookback_sessions"]) >= LEAST_LOOKBACK, f"the lookback spans {LEAST_LOOKBACK} sessions at least")
    require(0 <= float(p.get("min_hourly_density", 0)) <= 1, "a density lies in 0..1")
    require(float(p["target_return"]) > 0, "the target is above 0")
    require(isinstance(p["periods"], Mapping) and bool(p["periods"]), "periods are a mapping with entries")
    periods, before = {}, None
    for name, span in p["periods"].items():
        require(isinstance(span, (list, tuple)) and len(span) == 2, f"period {name} is a pair of days")
        a, b = (date.fromisoformat(str(x)) for x in span)
        require(a <= b, f"period {name} starts after its end")
        require(before is None or a > before, "periods follow one another without overlap")
        periods[str(name)], before = [a.isoformat(), b.isoformat()], b
    chosen = [str(x) for x in p["metric_periods"]]
    require(set(chosen) <= set(periods), f"metric periods {sorted(set(chosen) - set(periods))} are not declared")
    ticker = str(p["benchmark_ticker"]).strip().upper()
    require(bool(ticker), "the benchmark has a ticker")
    return p | {"start": start.isoformat(), "end": end.isoformat(), "periods": periods, "metric_periods": chosen, "benchmark_ticker": ticker}


def resolve_benchmark(aliases: DataFrame, ticker: str, start: str, end: str) -> str:
    """The one instrument the ticker names on every day of the span; anything else is an error."""
    parts = identity.alias_segments(aliases.filter(F.col("ticker") == ticker), start, end)
    held = parts.agg(F.count_if(F.col("status") != "resolved").alias("open"), F.countDistinct("owner").alias("owners"), F.min("owner").alias("owner")).first()
    if held.open or held.owners != 1:
        raise ValueError(f"benchmark {ticker} does not name one instrument over {start}..{end}")
    return held.owner


def register(name: str, run: Callable, replace: bool = False) -> None:
    """Register a study; a name is registered once unless it is replaced."""
    name = name.strip()
    if not name or not callable(run):
        raise ValueError("a study has a name and can be called")
    if name in _studies and not replace:
        raise ValueError(f"study {name} is registered already")
    _studies[name] = run


def registered() -> tuple[str, ...]:
    return tuple(sorted(_studies))


def dispatch(name: str, *args, **options):
    """Run a registered study."""
    if name.strip() not in _studies:
        raise ValueError(f"no study {name!r}; there are {', '.join(registered()) or 'none'}")
    return _studies[name.strip()](*args, **options)


def load_folder(folder: str) -> tuple[str, ...]:
    """Import the modules of a folder, which register their studies; returns the new names.

    Names that start with an underscore are left out; a folder that is not there has none.
    """
    before = set(registered())
    for path in sorted(Path(folder).glob("[!_]*.py")):
        name = f"barlake_studies_{path.stem}"
        spec = importlib.util.spec_from_file_location(name, path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        try:
            spec.loader.exec_module(module)
        except Exception:
            del sys.modules[name]
            raise
    return tuple(sorted(set(registered()) - before))
