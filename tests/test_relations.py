"""Derived relations hold every row of the tables they come from."""

from datetime import date, datetime, timedelta

from barlake.plans import registry
from barlake.plans.frames import Frames

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def orders(n=40):
    return [(k, 3 * k % 97, "FOP"[k % 3], 1.0, datetime(1996, 1, 1) + timedelta(days=5 * k % 130), "1") for k in range(1, n + 1)]


def alias_rows(rows):
    return {(f"S{c}", f"T{c + k % 3}", d.date(), d.date() + timedelta(days=30)) for k, c, _, _, d, _ in rows}


def test_aliases_and_evidence_hold_every_order(spark, tmp_path):
    rows = orders()
    spark.createDataFrame(rows, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    t = Frames(spark, str(tmp_path))
    assert {tuple(r) for r in t.aliases.collect()} == alias_rows(rows)
    state = {"F": "validated", "O": "unverified", "P": "rejected"}
    named = lambda k, c: f"vendor:V{c + k % 2}" if k % 4 == 0 else f"ticker:T{c + k % 7 % 3}"
    want = {(f"S{c}", named(k, c), f"t{c + k % 3}", d.date(), d.date() + timedelta(days=30), state[s]) for k, c, s, _, d, _ in rows}
    assert {tuple(r) for r in t.evidence.collect()} == want


def test_unique_tickers_by_brute_force(spark, tmp_path):
    rows = [(k, c, s, p, datetime(1997, 6, 1) if k % 3 else d, o) for k, c, s, p, d, o in orders()]
    spark.createDataFrame(rows, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    owners = {}
    for i, ticker, a, b in alias_rows(rows):
        if a <= date(1997, 6, 15) <= b:
            owners.setdefault(ticker, set()).add(i)
    want = {(ticker, *own) for ticker, own in owners.items() if len(own) == 1}
    got = registry.queries()["unique_tickers_asof"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


ITEMS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_returnflag string, l_tax double, l_discount double"


def test_bars_of_all_instruments_are_normalised_and_validated(spark, tmp_path):
    days = [datetime(1996, 3, d) for d in (4, 8, 9, 20)]
    rows = [(k, 1, 1, s, d, 100.0, 10.0, "N", 0.0, 0.0) for s in (7, 10, 123) for k, d in enumerate(days)]
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{tmp_path}/lineitem.parquet")
    normal = registry.queries()["normalize_eod"](spark, str(tmp_path)).collect()
    assert sorted((r.instrument_id, r.date) for r in normal) == sorted((f"S{s}", d.date()) for s in (7, 10, 123) for d in days)
    changes = registry.queries()["refresh_validate"](spark, str(tmp_path)).collect()
    # Of each instrument the 4th is lost, the 9th has another dividend, the 8th is delivered again as a new day.
    assert {(r.instrument_id, r.lost_dates, r.changed_actions, r.new_dates) for r in changes} == {(f"S{s}", 1, 1, 1) for s in (7, 10, 123)}
