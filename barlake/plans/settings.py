"""Parameters of the registered studies, scaled to the derived bars."""

from __future__ import annotations

from datetime import date

from barlake.sources.derive import BENCHMARK

__all__ = ["BENCHMARK"]

LOOKBACK, LONG_LOOKBACK = 5, 20
LONG_BENCHMARK = "S1"
GAP, TARGET, DENSITY = -0.03, 0.01, 0.05
STRESS = 0.6
MIN_EVENTS, MIN_LIFT = 10, 0.01
EPISODE_GAP, BRIDGE, FEWEST = 20, 2, 60
PERIODS = {
    "development": (date(2024, 1, 1), date(2024, 1, 12)),
    "validation": (date(2024, 1, 13), date(2024, 1, 22)),
    "test": (date(2024, 1, 23), date(2024, 1, 31)),
}
LONG_PERIODS = {
    "development": (date(1995, 1, 1), date(1998, 12, 31)),
    "validation": (date(1999, 1, 1), date(2000, 12, 31)),
    "test": (date(2001, 1, 1), date(2001, 12, 31)),
}
