import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barlake.operators import catalog, features, identity, ingest, quality
from barlake.sources import files, warehouse
from barlake.streaming.upsert import upsert_stream
from tests.test_studies import EOD, bar


@pytest.fixture
def store(spark, tmp_path):
    return warehouse.Warehouse(spark, f"file://{tmp_path}/bars")


def day(n):
    return date(2024, 1, n)


def test_publish_merges_and_replaces(spark, store):
    first = spark.createDataFrame([bar("A", day(2), 1.0, 2.0), bar("A", day(3), 2.0, 2.5), bar("B", day(2), 5.0, 5.0)], EOD)
    store.publish("eod", first)
    store.publish("eod", spark.createDataFrame([bar("A", day(3), 2.0, 9.0), bar("A", day(4), 9.0, 9.5)], EOD))
    got = {(r.instrument_id, r.date.day): r.close for r in store.read("eod").collect()}
    assert got == {("A", 2): 2.0, ("A", 3): 9.0, ("A", 4): 9.5, ("B", 2): 5.0}
    again = store.read("eod")
    store.publish("eod", spark.createDataFrame(again.collect(), EOD))
    assert store.read("eod").count() == 4  # publishing twice changes nothing
    store.publish("eod", spark.createDataFrame([bar("A", day(9), 7.0, 7.0)], EOD), replace_instruments=True)
    assert {(r.instrument_id, r.date.day) for r in store.read("eod").collect()} == {("A", 9), ("B", 2)}
    assert store.read("eod").columns == ingest.EOD_SCHEMA.names
    assert store.register_views() == ["eod"] and store.sql("SELECT count(*) AS n FROM eod").first().n == 2


def test_conflicting_rows_are_refused_and_copies_collapse(spark, store):
    with pytest.raises(ValueError):
        store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0), bar("A", day(2), 1.0, 3.0)], EOD))
    store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0)] * 2, EOD))
    assert store.read("eod").count() == 1
    with pytest.raises(ValueError):
        store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0)], EOD).drop("div_cash"))


def test_selectors_fail_closed(spark, store):
    store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0), bar("A", day(3), 1.0, 2.0)], EOD))
    assert store.load("eod", []).count() == 0
    assert [r.date.day for r in store.load("eod", ["A"], "2024-01-03", "2024-01-03").collect()] == [3]
    for bad in (["A", "Z"], [" "]):
        with pytest.raises(warehouse.SelectorError):
            store.load("eod", bad)
    aliases = spark.createDataFrame([("A", "OLD", day(1), day(2)), ("A", "NEW", day(3), day(9))], "instrument_id string, ticker string, start_date date, end_date date")
    assert [r.ticker for r in store.load_by_ticker("eod", ["old "], aliases, "2024-01-01", "2024-01-02").collect()] == ["OLD"]
    with pytest.raises(warehouse.SelectorError):
        store.load_by_ticker("eod", ["OLD"], aliases, "2024-01-01", "2024-01-03")


def test_intraday_is_split_by_year(spark, store):
    schema = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    rows = [("A", datetime(2023, 12, 29, 15), 1.0, 1.0, 1.0, 1.0, 1), ("A", datetime(2024, 1, 2, 15), 1.0, 1.0, 1.0, 1.0, 1)]
    store.publish("intraday_1hour", spark.createDataFrame(rows, schema))
    assert store.load("intraday_1hour", ["A"], "2024-01-01", "2024-01-31").count() == 1
    assert store.load_sessions("intraday_1hour", ["A"], date(2023, 12, 1), date(2024, 1, 31)).count() == 2


def test_point_reads_prune_buckets(spark, store):
    store.publish("eod", spark.createDataFrame([bar(n, day(2), 1.0, 2.0) for n in "ABCDEFGH"], EOD))
    one = {warehouse.bucket_of("A")}
    assert {f.split("bucket=")[1][:2] for f in store.read("eod", ["A"]).inputFiles()} == one
    assert len(store.read("eod").inputFiles()) == len({warehouse.bucket_of(n) for n in "ABCDEFGH"})


def test_intraday_loads_prune_years_and_push_times(spark, store):
    schema = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    rows = [(n, datetime(y, 3, 1, 15), 1.0, 1.0, 1.0, 1.0, 1) for n in "AB" for y in (2022, 2023, 2024)]
    store.publish("intraday_1hour", spark.createDataFrame(rows, schema))
    got = store.load("intraday_1hour", None, "2023-02-01", "2023-12-31")
    assert {f.split("year=")[1][:4] for f in got.inputFiles()} == {"2023"} and got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2023-02-01T00:00)" in plan and "LessThan(ts,2024-01-01T00:00)" in plan
    assert store.load("intraday_1hour", None, "2022-03-01", "2022-03-01").count() == 2


def test_a_failed_publication_leaves_the_old_rows(spark, store):
    store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0)], EOD))
    broken = spark.createDataFrame([bar("A", day(3), 1.0, 2.0)], EOD).withColumn("close", F.expr("IF(close > 0, raise_error('no'), close)"))
    with pytest.raises(Exception):
        store.publish("eod", broken)
    with pytest.raises(ValueError):
        store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0), bar("A", day(2), 1.0, 3.0)], EOD))
    assert [r.date.day for r in store.read("eod").collect()] == [2]
    assert not [n for n in files.names(spark, store.root) if n.startswith(".staging")]


def racing(monkeypatch, rival):
    """Let another writer publish between a publication's rows and its manifest."""
    write = files.write_new

    def late(*args):
        monkeypatch.undo()
        rival()
        return write(*args)

    monkeypatch.setattr(files, "write_new", late)


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    rows = {n: spark.createDataFrame([bar(n, day(2), 1.0, 2.0)], EOD) for n in "ABC"}
    store.publish("eod", rows["A"])
    racing(monkeypatch, lambda: store.publish("eod", rows["B"]))
    with pytest.raises(warehouse.ConflictError):
        store.publish("eod", rows["C"])
    assert sorted(r.instrument_id for r in store.read("eod").collect()) == ["A", "B"]
    assert len(store.vacuum()) >= 2 and store.read("eod").count() == 2


def test_writers_of_different_relations_follow_one_another(spark, store, monkeypatch):
    one = spark.createDataFrame([("A", "OLD")], TICKERS)
    store.publish("eod", spark.createDataFrame([bar("A", day(2), 1.0, 2.0)], EOD))
    racing(monkeypatch, lambda: store.put_metadata("tickers", one))
    store.publish("eod", spark.createDataFrame([bar("A", day(3), 1.0, 2.0)], EOD))
    assert store.publications() == [1, 2, 3] and store.read("eod").count() == 2 and store.metadata("tickers").first().ticker == "OLD"
    racing(monkeypatch, lambda: store.put_metadata("tickers", one))
    with pytest.raises(warehouse.ConflictError):
        store.put_metadata("tickers", one.withColumn("ticker", F.lit("LOST")))
    assert store.metadata("tickers").first().ticker == "OLD"


TICKERS = "instrument_id string, ticker string"


def test_relations_are_published_together_or_not_at_all(spark, store):
    names = lambda ticker: spark.createDataFrame([("A", ticker)], TICKERS)
    bars = lambda close: spark.createDataFrame([bar("A", day(2), 1.0, close)], EOD)
    assert store.commit({"eod": bars(2.0)}, {"tickers": names("OLD")}) == 1
    before = store.pin()
    seen = lambda s: (s.read("eod").first().close, s.metadata("tickers").first().ticker)
    faulty = names("BAD").withColumn("ticker", F.expr("IF(ticker = 'BAD', raise_error('no'), ticker)"))
    for datasets, metadata in (({"eod": bars(9.0)}, {"tickers": faulty}), ({"eod": bars(9.0).union(bars(8.0))}, {"tickers": names("BAD")})):
        with pytest.raises(Exception):
            store.commit(datasets, metadata)
        assert store.publications() == [1] and seen(store.pin()) == (2.0, "OLD")
    assert store.commit({"eod": bars(3.0)}, {"tickers": names("NEW")}) == 2
    assert seen(before) == (2.0, "OLD") and seen(store.pin(number=1)) == (2.0, "OLD") and seen(store.pin()) == (3.0, "NEW")
    store.register_views(number=1)
    assert spark.sql("SELECT close, ticker FROM eod JOIN meta_tickers USING (instrument_id)").first() == (2.0, "OLD")
    assert store.vacuum(keep=2) != [] and seen(store.pin(number=1)) == (2.0, "OLD")  # only what the failed ones left
    store.vacuum()
    assert seen(store.pin()) == (3.0, "NEW")
    for number in (1, 7):
        with pytest.raises(warehouse.SelectorError):
            store.pin(number=number)
    with pytest.raises(warehouse.SelectorError):
        store.pin([], ["none"])
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_replacing_an_instrument_reaches_all_its_years(spark, store):
    schema = "instrument_id string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    rows = [("A", datetime(y, 3, 1, 15), 1.0, 1.0, 1.0, 1.0, 1) for y in (2022, 2023)]
    store.publish("intraday_1hour", spark.createDataFrame(rows, schema))
    store.publish("intraday_1hour", spark.createDataFrame(rows[1:], schema).withColumn("volume", F.lit(9).cast("long")), replace_instruments=True)
    assert [(r.ts.year, r.volume) for r in store.read("intraday_1hour").collect()] == [(2023, 9)]


def test_metadata_and_frames_beside_the_bars(spark, store):
    store.publish("eod", spark.createDataFrame([bar(n, day(2), 1.0, 2.0) for n in "AB"], EOD))
    for name in ("old", "new"):
        store.put_metadata("tickers", spark.createDataFrame([("A", name)], "instrument_id string, ticker string"))
    store.register_frame("wanted", [("A",)], "instrument_id string")
    assert [r.ticker for r in store.sql("SELECT ticker FROM eod JOIN meta_tickers USING (instrument_id) JOIN wanted USING (instrument_id)").collect()] == ["new"]
    assert files.footer_counts(spark, [store.path("eod")]) == {store.path("eod"): 2}
    bounds = files.footers(spark, [store.path("eod")], ["instrument_id", "close", "none"]).collect()
    assert {(r.least, r.most) for r in bounds if r.column == "instrument_id"} <= {("A", "A"), ("B", "B"), ("A", "B")} and {r.least for r in bounds if r.column == "none"} == {None}
    assert files.footers(spark, [f"{store.root}/absent"]).count() == 0
    with pytest.raises(warehouse.SelectorError):
        store.metadata("none")


def test_layouts_spare_exchanges(spark, store, monkeypatch):
    rows = spark.createDataFrame([bar(n, day(d), 1.0, float(d)) for n in "ABCDEFGH" for d in range(2, 9)], EOD)
    new = spark.createDataFrame([bar("A", day(2), 1.0, 99.0), bar("Z", day(2), 1.0, 5.0)], EOD)
    with pytest.raises(warehouse.SelectorError):
        store.colocate("eod")
    store.publish("eod", rows)
    with pytest.raises(warehouse.SelectorError):
        store.pin().colocated("eod")
    store.colocate("eod", 8)
    held = store.pin()
    spark.sql(f"DROP TABLE {warehouse._table(held.layouts['eod'])}")  # as in a session that did not write it
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    exact = lambda df: sorted(map(str, df.collect()))
    wide = features.eod_features(held.colocated("eod"), 3)
    assert "Exchange" not in plan(wide) and exact(wide) == exact(features.eod_features(held.read("eod"), 3))
    racing(monkeypatch, lambda: store.publish("eod", new))
    with pytest.raises(warehouse.ConflictError):
        store.colocate("eod")  # of bars that are no longer the last ones
    assert store.pin().layouts == {} and held.colocated("eod").count() == 56
    store.colocate("eod")
    last = store.pin()
    assert last.layouts["eod"]["buckets"] == 1 and exact(last.colocated("eod")) == exact(last.read("eod"))
    store.put_metadata("tickers", spark.createDataFrame([("A", "OLD")], TICKERS))
    assert store.pin().layouts == last.layouts  # other relations leave it
    store.vacuum()
    assert [n for n in files.names(spark, store.path("eod")) if n.startswith("layout-")] == [last.layouts["eod"]["folder"]]
    assert store.pin().colocated("eod").count() == 57


def test_streamed_batches_merge(spark, store, tmp_path):
    schema = EOD + ", seq long"
    rows = [(*bar("A", day(2), 1.0, 2.0), 1), (*bar("A", day(2), 1.0, 3.0), 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, "eod", f"{tmp_path}/ck", "seq", once=True)
    q.awaitTermination(120)
    assert [r.close for r in store.read("eod").collect()] == [3.0]


def test_vendor_csv(spark):
    columns = ["date", "close", "volume"]
    assert [tuple(r) for r in warehouse.vendor_csv(spark, "﻿volume,date,close\n5,2024-01-02,\n", columns).collect()] == [("2024-01-02", None, "5")]
    assert warehouse.vendor_csv(spark, "date,close,volume\n", columns).count() == 0
    for bad in ('{"detail": "no"}', "date,close\n1,2", "date,date,close\n", "date,close,volume\n1,2\n"):
        with pytest.raises(ValueError):
            warehouse.vendor_csv(spark, bad, columns)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.csv", "ticker,exchange\nAA,NYSE\nBB,NYSE\n")
    assert warehouse.zipped_csv(spark, data.getvalue(), ["ticker", "exchange"], ["aa"]).count() == 1


def test_catalog_publishes_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    c = catalog.Catalog(spark, f"file://{tmp_path}/runs")
    frames = lambda n: (lambda: (spark.range(n).withColumn("x", F.col("id") * 2), spark.range(1)))
    a = c.publish("gap", 1, {"k": 1}, [f"{tmp_path}/in"], frames(3))
    b = c.publish("gap", 1, {"k": 1}, [f"{tmp_path}/in"], frames(2))
    assert c.load_observations([a, b]).count() == 5 and c.record(a)["fingerprint"] == c.record(b)["fingerprint"]
    with pytest.raises(ZeroDivisionError):
        c.publish("gap", 1, {}, [f"{tmp_path}/in"], lambda: 1 / 0)
    failed = [r for r in [p.name for p in (tmp_path / "runs").iterdir()] if c.record(r)["status"] == "failed"]
    with pytest.raises(catalog.RunError):
        c.load_observations(failed)
    with pytest.raises(catalog.RunError):
        c.drop(a)
    assert c.abandoned() == [] and json.loads(catalog.canonical_json({"b": 1, "a": 2})) == {"a": 2, "b": 1}
    other = c.publish("gap", 2, {}, [f"{tmp_path}/in"], frames(1))
    with pytest.raises(catalog.RunError):
        c.load_observations([a, other])


def test_quality_of_a_corrupted_table(spark):
    rows = [bar("A", day(n), 10.0, 11.0, volume=0) for n in (2, 3, 3, 5, 8, 9)]
    df = spark.createDataFrame(rows, EOD)
    df = df.withColumns({"high": F.when(F.col("date") == "2024-01-05", 1.0).otherwise(F.col("high")), "div_cash": F.when(F.col("date") == "2024-01-08", -1.0).otherwise(0.0), "split_factor": F.when(F.col("date") == "2024-01-09", 0.0).otherwise(1.0)})
    from barlake.functions import calendar

    schedule = calendar.session_schedule(spark, day(2), day(9))
    assert tuple(quality.duplicate_keys(df).first())[1:] == (1, 1, "2024-01-03")
    assert quality.ohlc_invariants(df).first().n_raw == 1 and quality.negative_values(df).first().n_value == 1
    assert quality.split_sanity(df).first().sample == "2024-01-09"
    coverage = spark.createDataFrame([("A", day(2), day(9))], "instrument_id string, first_date date, last_date date")
    assert quality.missing_sessions(df, coverage, schedule).first().sample == "2024-01-04"
    runs = quality.zero_volume_runs(df, calendar.with_index(schedule), 2).orderBy("first_date").collect()
    assert [(r.first_date.day, r.last_date.day, r.n_sessions) for r in runs] == [(2, 3, 2), (5, 9, 3)]


def test_alias_segments_tile_the_span(spark):
    rows = [("A", "REUSE", date(2000, 1, 1), date(2010, 12, 31)), ("B", "REUSE", date(2012, 1, 1), date(2025, 1, 1)), ("C", "REUSE", date(2018, 1, 1), date(2019, 12, 31))]
    aliases = spark.createDataFrame(rows, "instrument_id string, ticker string, start_date date, end_date date")
    got = [(str(r.first), r.status, r.owner) for r in identity.alias_segments(aliases, "2010-01-01", "2020-12-31").orderBy("first").collect()]
    assert got == [("2010-01-01", "resolved", "A"), ("2011-01-01", "zero", None), ("2012-01-01", "resolved", "B"), ("2018-01-01", "multiple", None), ("2020-01-01", "resolved", "B")]
