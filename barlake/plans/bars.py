"""Scans, loaders, features, calendars, quality and ingestion."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barlake.functions import calendar, exprs
from barlake.operators import catalog, features, health, identity, ingest, quality, reconcile
from barlake.plans import oracle
from barlake.plans import settings as S
from barlake.plans.frames import own_warehouse
from barlake.plans.registry import plan
from barlake.sources import files, warehouse

EOD = "instrument_id, date, open, high, low, close, volume, adj_open, adj_high, adj_low, adj_close, adj_volume, div_cash, split_factor"
ROUNDED = "adv_dollars realized_vol prior_5_return prior_window_return gap_return gap_vol_normalized".split()
LABEL = "session_date, session_open, session_close, is_early_close"
SAMPLE = "array_to_string(list_slice(list(CAST({0} AS VARCHAR) ORDER BY {0}), 1, 10), ',')"


def _round(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@plan("scan_eod_bars", f"SELECT {EOD} FROM long")
def _(t):
    return ingest.canonical(t.long)


@plan("scan_file_bounds", "SELECT 'events.parquet' AS file, CAST(count(*) AS BIGINT) AS n_rows, min(ts) AS first_value, max(ts) AS last_value FROM events")
def _(t):
    return warehouse.file_bounds(t.read("events"), "ts")


@plan("load_eod", f"SELECT {EOD} FROM long WHERE instrument_id IN ('S1', 'S3', 'S7') AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def _(t):
    return warehouse.select_range(quality.scoped(t.long, ["S1", "S3", "S7"]), "1996-01-01", "1998-12-31")


@plan("load_intraday", "SELECT * FROM hourly WHERE instrument_id = 'view-0' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'")
def _(t):
    return warehouse.select_range(quality.scoped(t.hourly, ["view-0"]), "2024-01-08", "2024-01-12")


def _labelled(relation: str, freq: str) -> str:
    step = calendar.BAR_MINUTES[freq]
    local = oracle.ny("b.ts")
    rule = f"minute({local}) = 0 AND hour({local}) >= 10" if freq == "1hour" else "CAST(floor((epoch(b.ts) - epoch(s.session_open)) / 60) AS INTEGER) % 5 = 0"
    return f"""SELECT b.*, {LABEL}, CAST(floor((epoch(b.ts) - epoch(s.session_open)) / 60) AS INTEGER) AS minutes_from_open, '{calendar.SEMANTICS[freq]}' AS bar_label_semantics
        FROM {relation} b JOIN sessions s ON s.session_date = CAST(b.ts AS DATE) WHERE b.ts >= session_open AND b.ts + INTERVAL {step} MINUTE <= session_close AND {rule}"""


@plan("load_intraday_sessions", _labelled("hourly", "1hour") + " AND b.instrument_id IN ('view-0', 'error-1', 'click-2')")
def _(t):
    return calendar.label_sessions(quality.scoped(t.hourly, ["view-0", "error-1", "click-2"]), t.sessions, "1hour")


@plan("label_sessions_hourly", _labelled("hourly", "1hour"))
def _(t):
    return calendar.label_sessions(t.hourly, t.sessions, "1hour")


@plan("label_sessions_5min", _labelled("five", "5min"))
def _(t):
    return calendar.label_sessions(t.five, t.sessions, "5min")


@plan("load_eod_by_ticker", "SELECT b.*, s.ticker FROM long b JOIN segs s ON s.owner = b.instrument_id AND b.date BETWEEN s.first AND s.last WHERE s.status = 'resolved' AND s.ticker IN ('T1', 'T2', 'T3')")
def _(t):
    return warehouse.by_segments(t.long, t.segments.filter(F.col("ticker").isin("T1", "T2", "T3")))


UNIVERSE = """SELECT c_custkey AS line, CAST(1995 + c_custkey % 3 AS INTEGER) AS year, 'K' || (c_custkey // 90 * 30 + c_custkey % 30) AS ticker,
    CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 3 = 2 THEN CAST(c_custkey AS INTEGER) END AS rank, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS dollar_volume FROM customer"""


@plan("universe_import", f"""SELECT k.year, k.ticker, CAST(CASE WHEN bool_or(k.rank IS NULL) OVER (PARTITION BY k.year) THEN rank() OVER (PARTITION BY k.year ORDER BY coalesce(k.dollar_volume, 0) DESC, f.line) ELSE k.rank END AS INTEGER) AS rank, k.dollar_volume, f.conflicts
    FROM (SELECT DISTINCT ON (year, ticker) * FROM ({UNIVERSE}) ORDER BY year, ticker, coalesce(dollar_volume, 0) DESC, line) k
    JOIN (SELECT year, ticker, min(line) AS line, count(DISTINCT concat_ws('/', coalesce(rank, -1), coalesce(dollar_volume, -1e9))) - 1 AS conflicts FROM ({UNIVERSE}) GROUP BY 1, 2) f ON f.year = k.year AND f.ticker = k.ticker""")  # fmt: skip
def _(t):
    k = F.col("c_custkey")
    ticker = F.concat(F.lit(" k"), F.floor(k / 90) * 30 + k % 30)
    rank = F.when((k % 5 != 0) | (k % 3 == 2), k.cast("int"))
    return ingest.universe_import(t.read("customer").select(k.alias("line"), (k % 3 + 1995).cast("int").alias("year"), ticker.alias("ticker"), rank.alias("rank"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("dollar_volume")))


@plan("normalize_eod", f"SELECT {EOD} FROM long")
def _(t):
    vendor = t.long.withColumnsRenamed({v: k for k, v in ingest.VENDOR.items()})
    return ingest.normalize_eod(vendor.select([(F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z")) if c == "date" else F.col(c).cast("string")).alias(c) for c in vendor.columns]))


UPSERT = "SELECT * FROM incoming UNION ALL SELECT * FROM long b WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.instrument_id = b.instrument_id AND i.date = b.date)"


@plan("publish_upsert", f"SELECT instrument_id, CAST(count(*) AS BIGINT) AS n_rows, sum(open) AS sum_open FROM ({UPSERT}) GROUP BY 1")
def _(t):
    w = own_warehouse(t, "publish")
    w.publish("eod", t.long)
    w.publish("eod", t.incoming)
    return w.read("eod").groupBy("instrument_id").agg(F.count("*").alias("n_rows"), F.sum("open").alias("sum_open"))


@plan("metadata_relations", "SELECT b.instrument_id, CAST(count(*) AS BIGINT) AS n_bars, min(b.date) AS first_bar, c.first_date, c.last_date FROM eod b JOIN coverage c ON c.instrument_id = b.instrument_id WHERE b.instrument_id IN ('view-1', 'click-2') GROUP BY ALL")
def _(t):
    """Bars, a metadata relation and a list from the driver's memory in one statement."""
    w = own_warehouse(t, "metadata")
    w.publish("eod", t.eod)
    w.put_metadata("coverage", t.coverage)
    w.register_frame("wanted", [("view-1",), ("click-2",)], "instrument_id string")
    return w.sql("""SELECT b.instrument_id, count(*) AS n_bars, min(b.date) AS first_bar, c.first_date, c.last_date FROM eod b JOIN wanted w ON w.instrument_id = b.instrument_id
        JOIN meta_coverage c ON c.instrument_id = b.instrument_id GROUP BY b.instrument_id, c.first_date, c.last_date""")


_AT = "SELECT CAST({0} AS INTEGER) AS publication, b.instrument_id, CAST(count(*) AS BIGINT) AS n_bars, CAST(sum(b.volume) AS BIGINT) AS volume, c.first_date FROM ({1}) b JOIN ({2}) c ON c.instrument_id = b.instrument_id GROUP BY ALL"


@plan("read_as_of", _AT.format(1, "SELECT * FROM eod", "SELECT * FROM coverage") + " UNION ALL "
    + _AT.format(2, "SELECT * REPLACE (CASE WHEN instrument_id LIKE '%-1' THEN volume + 1 ELSE volume END AS volume) FROM eod", "SELECT * FROM coverage WHERE instrument_id NOT LIKE '%-2'"))
def _(t):
    """Bars and their coverage, published together twice and read as of each publication."""
    w = own_warehouse(t, "as-of")
    w.commit({"eod": t.eod}, {"coverage": t.coverage})
    changed = t.eod.filter("instrument_id LIKE '%-1'").withColumn("volume", F.col("volume") + 1)
    w.commit({"eod": changed}, {"coverage": t.coverage.filter("instrument_id NOT LIKE '%-2'")})

    def seen(number):
        held = w.pin(number=number)
        sums = held.read("eod").groupBy("instrument_id").agg(F.count("*").alias("n_bars"), F.sum("volume").alias("volume"))
        return sums.join(held.metadata("coverage").select("instrument_id", "first_date"), "instrument_id").withColumn("publication", F.lit(number))

    return seen(1).unionByName(seen(2))


@plan("footer_counts", " UNION ALL ".join(f"SELECT '{n}' AS dataset_key, CAST(count(*) AS BIGINT) AS n_rows FROM {r}" for n, r in (("eod", "eod"), ("intraday_1hour", "hourly"))))
def _(t):
    """Rows of published datasets by their files' footers."""
    w = own_warehouse(t, "footers")
    w.publish("eod", t.eod)
    w.publish("intraday_1hour", t.hourly)
    found = files.footers(t.spark, [w.path(d) for d in ("eod", "intraday_1hour")])
    return found.groupBy(F.element_at(F.split("folder", "/"), -1).alias("dataset_key")).agg(F.sum("n_rows").alias("n_rows"))


@plan("footer_bounds", """SELECT substr(sha256(instrument_id), 1, 2) AS bucket, CAST(count(*) AS BIGINT) AS n_rows, min(instrument_id) AS first_instrument, max(instrument_id) AS last_instrument, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM long GROUP BY 1""")
def _(t):
    """Bounds of a published dataset's buckets, from the statistics of its row groups alone."""
    w = own_warehouse(t, "bounds")
    w.publish("eod", t.long)
    found = files.footers(t.spark, [w.path("eod")], ["instrument_id", "date"])
    of = lambda column, value: F.when(F.col("column") == column, F.col(value))
    return found.groupBy(F.regexp_extract("file", "bucket=([0-9a-f]+)", 1).alias("bucket")).agg(
        F.sum(of("date", "n_rows")).alias("n_rows"), F.min(of("instrument_id", "least")).alias("first_instrument"), F.max(of("instrument_id", "most")).alias("last_instrument"),
        F.min(of("date", "least")).alias("first_date"), F.max(of("date", "most")).alias("last_date"),
    )


BEFORE = "SELECT * FROM long WHERE instrument_id NOT LIKE '%4'"
AFTER = "SELECT * REPLACE (CASE WHEN instrument_id LIKE '%2' THEN volume + 1 ELSE volume END AS volume) FROM long WHERE instrument_id NOT LIKE '%5'"
_HELD = "SELECT substr(sha256(instrument_id), 1, 2) AS bucket, CAST(count(*) AS BIGINT) AS n FROM ({0}) GROUP BY 1"


@plan("manifest_diff", f"""SELECT bucket, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'added' WHEN d.bucket IS NULL THEN 'unchanged' ELSE 'changed' END AS status, b.n AS rows_before, a.n AS rows_after
    FROM ({_HELD.format(BEFORE)}) b FULL JOIN ({_HELD.format(AFTER)}) a USING (bucket)
    LEFT JOIN (SELECT DISTINCT substr(sha256(instrument_id), 1, 2) AS bucket FROM (((SELECT * FROM ({BEFORE})) EXCEPT (SELECT * FROM ({AFTER}))) UNION ALL ((SELECT * FROM ({AFTER})) EXCEPT (SELECT * FROM ({BEFORE}))))) d USING (bucket)""")  # fmt: skip
def _(t):
    """Buckets that two publications have in common, changed, lost and gained, by the content of their files."""
    found = []
    changed = t.long.withColumn("volume", F.when(F.col("instrument_id").like("%2"), F.col("volume") + 1).otherwise(F.col("volume")))
    for name, rows in (("before", t.long.filter("instrument_id NOT LIKE '%4'")), ("after", changed.filter("instrument_id NOT LIKE '%5'"))):
        w = own_warehouse(t, name)
        w.publish("eod", rows)
        found.append(catalog.input_manifest(t.spark, {"eod": w.pin(["eod"]).files("eod")}, by_partition=True).withColumn("bucket", F.regexp_extract("path", "bucket=([0-9a-f]+)", 1)))
    return catalog.manifest_diff(*found, key="bucket")


@plan("merge_upsert", UPSERT)
def _(t):
    return ingest.merge_upsert(t.long, t.incoming)


@plan("snapshot_replace", "SELECT * FROM incoming WHERE instrument_id IN (SELECT instrument_id FROM funds) UNION ALL SELECT * FROM long WHERE instrument_id NOT IN (SELECT f.instrument_id FROM funds f JOIN incoming i ON i.instrument_id = f.instrument_id)")
def _(t):
    return ingest.snapshot_replace(t.long, t.incoming.join(t.funds, "instrument_id", "left_semi"))


@plan("point_read", "SELECT instrument_id, date, open, close, volume FROM long WHERE instrument_id = 'S5'")
def _(t):
    return t.long.filter(F.col("instrument_id") == "S5").select("instrument_id", "date", "open", "close", "volume")


INVALID = "({0} IS NULL OR {1} IS NULL OR {2} IS NULL OR {3} IS NULL OR {1} < greatest({0}, {2}, {3}) OR {2} > least({0}, {1}, {3}))"
RAW, ADJUSTED = INVALID.format("open", "high", "low", "close"), INVALID.format("adj_open", "adj_high", "adj_low", "adj_close")


@plan("ohlc_invalid_rows", f"SELECT instrument_id, date, open, high, low, close FROM dirty WHERE {RAW}")
def _(t):
    return t.dirty.filter(exprs.ohlc_invalid()).select("instrument_id", "date", "open", "high", "low", "close")


@plan("quarantine_ohlc", f"SELECT instrument_id, date, CASE WHEN {RAW} THEN 'quarantined' ELSE 'accepted' END AS disposition FROM dirty")
def _(t):
    return t.dirty.select("instrument_id", "date", F.when(exprs.ohlc_invalid(), "quarantined").otherwise("accepted").alias("disposition"))


@plan("q_duplicate_keys", f"SELECT instrument_id, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows, {SAMPLE.format('date')} AS sample FROM (SELECT instrument_id, date, count(*) AS n FROM dirty GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def _(t):
    return quality.duplicate_keys(t.dirty)


@plan("q_ohlc_invariants", f"SELECT * FROM (SELECT instrument_id, CAST(count(*) FILTER (WHERE {RAW}) AS BIGINT) AS n_raw, CAST(count(*) FILTER (WHERE {ADJUSTED}) AS BIGINT) AS n_adjusted FROM dirty GROUP BY 1) WHERE n_raw + n_adjusted > 0")
def _(t):
    return quality.ohlc_invariants(t.dirty)


NEGATIVE = " OR ".join(f"coalesce({c} < 0, false)" for c in "open high low close adj_open adj_high adj_low adj_close div_cash".split())


@plan("q_negative_values", f"SELECT * FROM (SELECT instrument_id, CAST(count(*) FILTER (WHERE volume IS NULL OR volume < 0) AS BIGINT) AS n_volume, CAST(count(*) FILTER (WHERE {NEGATIVE}) AS BIGINT) AS n_value FROM dirty GROUP BY 1) WHERE n_volume + n_value > 0")
def _(t):
    return quality.negative_values(t.dirty)


@plan("q_split_sanity", f"SELECT instrument_id, CAST(count(*) AS BIGINT) AS n, {SAMPLE.format('date')} AS sample FROM dirty WHERE split_factor IS NULL OR split_factor <= 0 GROUP BY 1")
def _(t):
    return quality.split_sanity(t.dirty)


#: a bar is zero where every copy of it has a known volume of 0
ZERO = "count(volume) = count(*) AND min(volume) = 0 AND max(volume) = 0"


@plan("q_zero_volume_runs", f"""SELECT instrument_id, min(date) AS first_date, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n_sessions FROM (
    SELECT *, sum(CASE WHEN held AND before AND session_index = last_index + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY date) AS run FROM (
      SELECT *, lag(held, 1, false) OVER w AS before, lag(session_index) OVER w AS last_index FROM (
        SELECT instrument_id, date, session_index, {ZERO} AS held FROM dirty JOIN long_sessions ON session_date = date GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY instrument_id ORDER BY date)))
    WHERE held GROUP BY instrument_id, run HAVING count(*) >= 2""")  # fmt: skip
def _(t):
    return quality.zero_volume_runs(t.dirty, t.indexed, 2)


@plan("q_zero_volume_bars", f"""SELECT instrument_id, session_date, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n_bars FROM (
    SELECT *, sum(CASE WHEN held AND before AND session_date = last_session AND ts = last_ts + INTERVAL 5 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY ts) AS run FROM (
      SELECT *, lag(held, 1, false) OVER w AS before, lag(session_date) OVER w AS last_session, lag(ts) OVER w AS last_ts FROM (
        SELECT instrument_id, ts, session_date, {ZERO} AS held FROM ({_labelled("five", "5min")}) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)))
    WHERE held GROUP BY instrument_id, session_date, run""")  # fmt: skip
def _(t):
    return quality.zero_volume_bar_runs(t.five, t.sessions, "5min", 1)


@plan("quality_scope", "SELECT instrument_id, dataset_key, greatest(first_date, DATE '2024-01-10') AS first_date, least(last_date, DATE '2024-01-20') AS last_date FROM coverage WHERE instrument_id IN ('view-0', 'error-1', 'click-2') AND first_date <= DATE '2024-01-20' AND last_date >= DATE '2024-01-10'")
def _(t):
    return quality.clipped(t.coverage, ["view-0", "error-1", "click-2"], "2024-01-10", "2024-01-20")


def _finding(check: str, message: str, relation: str) -> str:
    return f"SELECT 'eod' AS dataset_key, '{check}' AS \"check\", instrument_id, 'error' AS severity, {message} AS message FROM {relation}"


@plan("quality_findings", " UNION ALL ".join([
    _finding("ohlc_invariants", "(n_raw + n_adjusted) || ' invalid'", f"(SELECT instrument_id, count(*) FILTER (WHERE {RAW}) AS n_raw, count(*) FILTER (WHERE {ADJUSTED}) AS n_adjusted FROM dirty GROUP BY 1) WHERE n_raw + n_adjusted > 0"),
    _finding("duplicate_keys", "(count(*) || ' repeated')", "(SELECT instrument_id, date FROM dirty GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY instrument_id"),
    _finding("split_sanity", "(count(*) || ' invalid')", "dirty WHERE split_factor IS NULL OR split_factor <= 0 GROUP BY instrument_id"),
]))
def _(t):
    found = lambda check, df, text: df.select(F.lit("eod").alias("dataset_key"), F.lit(check).alias("check"), "instrument_id", F.lit(quality.CHECKS[check][0]).alias("severity"), text.alias("message"))
    every = found("ohlc_invariants", quality.ohlc_invariants(t.dirty), F.concat(F.col("n_raw") + F.col("n_adjusted"), F.lit(" invalid")))
    every = every.union(found("duplicate_keys", quality.duplicate_keys(t.dirty), F.concat("n_keys", F.lit(" repeated"))))
    return quality.ordered_findings(every.union(found("split_sanity", quality.split_sanity(t.dirty), F.concat("n", F.lit(" invalid")))))


@plan("q_missing_sessions", f"""SELECT instrument_id, CAST(count(*) AS BIGINT) AS n, {SAMPLE.format('session_date')} AS sample FROM (
    SELECT c.instrument_id, s.session_date FROM coverage c JOIN sessions s ON s.session_date BETWEEN c.first_date AND c.last_date
    WHERE NOT EXISTS (SELECT 1 FROM eod b WHERE b.instrument_id = c.instrument_id AND b.date = s.session_date AND b.volume > 2)) GROUP BY 1""")  # fmt: skip
def _(t):
    return quality.missing_sessions(t.eod.filter("volume > 2"), t.coverage, t.sessions)


@plan("q_off_session", f"""SELECT b.instrument_id, CAST(count(*) AS BIGINT) AS n FROM hourly b LEFT JOIN sessions s ON s.session_date = CAST(b.ts AS DATE)
    WHERE NOT coalesce(b.ts >= session_open AND b.ts + INTERVAL 1 HOUR <= session_close AND minute({oracle.ny('b.ts')}) = 0 AND hour({oracle.ny('b.ts')}) >= 10, false) GROUP BY 1""")  # fmt: skip
def _(t):
    return quality.off_session(t.hourly, t.sessions, "1hour")


HELD = "SELECT instrument_id, CAST(count(*) AS BIGINT) AS n_rows, min(date) AS first_bar, max(date) AS last_bar FROM eod GROUP BY 1"


@plan("q_coverage_summary", f"""SELECT instrument_id, coalesce(n_rows, 0) AS n_rows, first_bar, last_bar, first_date, last_date, CASE WHEN n_rows IS NULL THEN 'no_rows' WHEN first_date IS NULL THEN 'orphan_rows'
    WHEN first_bar < first_date OR last_bar > last_date THEN 'outside_coverage' ELSE 'ok' END AS status
    FROM ({HELD}) FULL JOIN (SELECT instrument_id, first_date, last_date FROM coverage WHERE instrument_id <> 'error-1' UNION ALL SELECT 'ghost', DATE '2024-01-02', DATE '2024-01-03') USING (instrument_id)""")  # fmt: skip
def _(t):
    more = t.coverage.filter("instrument_id <> 'error-1'").select("instrument_id", "first_date", "last_date").union(t.spark.sql("SELECT 'ghost', DATE'2024-01-02', DATE'2024-01-03'"))
    return quality.coverage_summary(t.eod, more)


@plan("coverage_summary", "SELECT instrument_id, CAST(count(*) AS BIGINT) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM long GROUP BY 1")
def _(t):
    return t.long.groupBy("instrument_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@plan("quality_gate", f"""SELECT c."check", c.severity, coalesce(f.n, -1) AS findings, c.declared AND (f.n IS NULL OR (f.n > 0 AND c.severity IN ('warning', 'error'))) AS blocks FROM (VALUES
    {", ".join(f"('{k}', '{v[0]}', {str(k in ('duplicate_keys', 'split_sanity', 'off_session_intraday')).lower()})" for k, v in quality.CHECKS.items())}) c("check", severity, declared) LEFT JOIN (
    SELECT 'duplicate_keys' AS "check", CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM long GROUP BY instrument_id, date HAVING count(*) > 1)
    UNION ALL SELECT 'split_sanity', CAST(count(*) AS BIGINT) FROM dirty WHERE split_factor <= 0
    UNION ALL SELECT 'ohlc_invariants', CAST(count(*) AS BIGINT) FROM dirty WHERE {RAW}) f ON f."check" = c."check" """)  # fmt: skip
def _(t):
    n = F.count("*").alias("findings")
    counts = (
        t.long.groupBy("instrument_id", "date").count().filter("count > 1").agg(n).withColumn("check", F.lit("duplicate_keys"))
        .unionByName(t.dirty.filter("split_factor <= 0").agg(n).withColumn("check", F.lit("split_sanity")))
        .unionByName(t.dirty.filter(exprs.ohlc_invalid()).agg(n).withColumn("check", F.lit("ohlc_invariants")))
    )
    return quality.gate(counts, ("duplicate_keys", "split_sanity", "off_session_intraday"))


def _ran(dataset: str, checks: dict[str, str]) -> str:
    """Findings by instrument of each check, and a row that says that it ran; each relation is (instrument_id, n)."""
    severity = {k: v[0] for k, v in quality.CHECKS.items()}
    parts = [f"SELECT '{dataset}' AS dataset_key, '{c}' AS \"check\", instrument_id, '{severity[c]}' AS severity, CAST(n AS BIGINT) AS findings FROM ({sql}) WHERE n > 0" for c, sql in checks.items()]
    return " UNION ALL ".join([*parts, *(f"SELECT '{dataset}', '{c}', NULL, '{severity[c]}', CAST(0 AS BIGINT)" for c in checks)])


def _zero_runs(relation: str, key: str, within: str, step: str, shortest: int) -> str:
    return f"""SELECT instrument_id, count(*) AS n FROM (SELECT instrument_id, {within}, d FROM (SELECT instrument_id, {within}, {step} - row_number() OVER (PARTITION BY instrument_id, {within} ORDER BY {key}) AS d
        FROM (SELECT instrument_id, {key}, {within}, {step}, {ZERO} AS held FROM {relation} GROUP BY ALL) WHERE held) GROUP BY ALL HAVING count(*) >= {shortest}) GROUP BY 1"""


_BADLY = "count(*) FILTER (WHERE volume IS NULL OR volume < 0) + count(*) FILTER (WHERE {0})"
_LOW = " OR ".join(f"coalesce({c} < 0, false)" for c in ("open", "high", "low", "close"))
_DAILY_CHECKS = {
    "missing_expected_sessions": "SELECT i.instrument_id, count(*) AS n FROM (SELECT instrument_id, min(date) AS a, max(date) AS z FROM dirty GROUP BY 1) i JOIN long_sessions s ON s.session_date BETWEEN i.a AND i.z WHERE NOT EXISTS (SELECT 1 FROM dirty b WHERE b.instrument_id = i.instrument_id AND b.date = s.session_date) GROUP BY 1",
    "duplicate_keys": "SELECT instrument_id, count(*) AS n FROM (SELECT instrument_id, date FROM dirty GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
    "ohlc_invariants": f"SELECT instrument_id, count(*) FILTER (WHERE {RAW}) + count(*) FILTER (WHERE {ADJUSTED}) AS n FROM dirty GROUP BY 1",
    "negative_values": f"SELECT instrument_id, {_BADLY.format(NEGATIVE)} AS n FROM dirty GROUP BY 1",
    "zero_volume_runs": _zero_runs("dirty JOIN long_sessions ON session_date = date", "date", "1 AS within_all", "session_index", 2).replace("1 AS within_all, session_index", "session_index").replace("1 AS within_all, ", "").replace(", 1 AS within_all", ""),
    "split_sanity": "SELECT instrument_id, count(*) AS n FROM dirty WHERE split_factor IS NULL OR split_factor <= 0 GROUP BY 1",
    "coverage_delisting_summary": "SELECT instrument_id, 0 AS n FROM dirty",
}


def _bar_checks(relation: str, freq: str) -> dict[str, str]:
    regular = _labelled(relation, freq)
    return {
        "duplicate_keys": f"SELECT instrument_id, count(*) AS n FROM (SELECT instrument_id, ts FROM {relation} GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
        "ohlc_invariants": f"SELECT instrument_id, count(*) FILTER (WHERE {RAW}) AS n FROM {relation} GROUP BY 1",
        "negative_values": f"SELECT instrument_id, {_BADLY.format(_LOW)} AS n FROM {relation} GROUP BY 1",
        "zero_volume_runs": _zero_runs(f"(SELECT *, CAST(floor(minutes_from_open / {calendar.BAR_MINUTES[freq]}) AS BIGINT) AS step FROM ({regular}))", "ts", "session_date", "step", 2),
        "off_session_intraday": f"SELECT a.instrument_id, a.n - coalesce(r.n, 0) AS n FROM (SELECT instrument_id, count(*) AS n FROM {relation} GROUP BY 1) a LEFT JOIN (SELECT instrument_id, count(*) AS n FROM ({regular}) GROUP BY 1) r USING (instrument_id)",
        "coverage_delisting_summary": f"SELECT instrument_id, 0 AS n FROM {relation}",
    }


@plan("quality_run", " UNION ALL ".join([_ran("eod", _DAILY_CHECKS), _ran("intraday_1hour", _bar_checks("hourly", "1hour"))]))
def _(t):
    """All eight checks over daily and hourly bars, each dataset read once."""
    return quality.run_checks({"eod": t.dirty, "intraday_1hour": t.hourly}, t.all_sessions, shortest=2)


FEATURES = f"instrument_id, date, open_raw, adj_open, prior_date, prior_close_raw, prior_adj_close, lookback_start_date, prior_sessions_present, adj_close_6_back, event_day_corporate_action, {_round(ROUNDED)}"


@plan("eod_features", f"SELECT {FEATURES} FROM feat_l")
def _(t):
    return t.feat_l.withColumns(exprs.rounded(ROUNDED))


@plan("features_colocated", f"SELECT {FEATURES} FROM feat_l")
def _(t):
    """The features of all published bars from their layout, with no exchange."""
    w = own_warehouse(t, "layout")
    w.publish("eod", t.long)
    w.colocate("eod")
    return features.eod_features(w.pin().colocated("eod"), S.LONG_LOOKBACK).withColumns(exprs.rounded(ROUNDED))


@plan("corp_action_flag", "SELECT instrument_id, bool_or(coalesce(div_cash, 0) > 0 OR coalesce(split_factor, 1) <> 1) AS any_action, CAST(count(*) FILTER (WHERE coalesce(div_cash, 0) > 0 OR coalesce(split_factor, 1) <> 1) AS BIGINT) AS n FROM long GROUP BY 1")
def _(t):
    return t.long.groupBy("instrument_id").agg(F.bool_or(exprs.corporate_action()).alias("any_action"), F.count_if(exprs.corporate_action()).alias("n"))


@plan("density_hourly", f"SELECT instrument_id, date, prior_traded_bars, prior_expected_bars, {_round(['hourly_density'])} FROM density_h")
def _(t):
    return t.density_h.withColumns(exprs.rounded(["hourly_density"]))


@plan("density_5min", f"SELECT instrument_id, date, prior_traded_bars, prior_expected_bars, {_round(['five_min_density'])} FROM density_f")
def _(t):
    return t.density_f.withColumns(exprs.rounded(["five_min_density"]))


@plan("session_schedule", f"SELECT {LABEL}, CAST(count(b.instrument_id) AS BIGINT) AS n_bars FROM long_sessions LEFT JOIN long b ON b.date = session_date GROUP BY ALL")
def _(t):
    """Every session with its times, and how many instruments have a bar on it."""
    held = t.long.groupBy(F.col("date").alias("session_date")).agg(F.count("*").alias("n_bars"))
    return t.long_sessions.join(held, "session_date", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))


@plan("session_index", "SELECT instrument_id, min(session_index) AS first_session, max(session_index) AS last_session, CAST(count(*) AS BIGINT) AS n_bars FROM long JOIN long_sessions ON session_date = date GROUP BY 1")
def _(t):
    """The first and last session on which an instrument has a bar, by number."""
    numbered = t.long.join(F.broadcast(t.indexed.select(F.col("session_date").alias("date"), "session_index")), "date")
    return numbered.groupBy("instrument_id").agg(F.min("session_index").alias("first_session"), F.max("session_index").alias("last_session"), F.count("*").alias("n_bars"))


@plan("next_session", "SELECT d.date, min(s.session_date) AS next_session FROM (SELECT DISTINCT date FROM eod) d JOIN sessions s ON s.session_date > d.date GROUP BY 1")
def _(t):
    return calendar.next_sessions(t.eod.select("date").distinct(), t.sessions)


@plan("expected_labels", "SELECT l.ts, l.session_date, CAST(count(b.instrument_id) AS BIGINT) AS n_bars FROM labels_five l LEFT JOIN five b ON b.ts = l.ts GROUP BY 1, 2")
def _(t):
    """Every bar that a session should have, and how many instruments have it."""
    held = t.five.groupBy("ts").agg(F.count("*").alias("n_bars"))
    return calendar.expected_labels(t.sessions, "5min").join(held, "ts", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))


@plan("canonical_dup_check", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(v) AS BIGINT) AS distinct_rows, CAST(count(*) FILTER (WHERE v > 1) AS BIGINT) AS conflicting_keys, CAST(count(*) FILTER (WHERE instrument_id IS NULL OR date IS NULL) AS BIGINT) AS null_keys FROM (SELECT instrument_id, date, count(*) AS v, sum(c) AS n FROM (SELECT *, count(*) AS c FROM (SELECT * FROM dirty UNION ALL SELECT * FROM incoming) GROUP BY ALL) GROUP BY 1, 2)")
def _(t):
    return ingest.duplicate_conflicts(t.dirty.unionByName(t.incoming))


@plan("coverage_gaps", """SELECT instrument_id, part, a AS start_date, b AS end_date FROM (
    SELECT w.instrument_id, 'whole' AS part, DATE '2023-12-28' AS a, DATE '2024-02-02' AS b FROM (SELECT DISTINCT instrument_id FROM eod) w WHERE w.instrument_id LIKE '%-2'
    UNION ALL SELECT instrument_id, 'leading', DATE '2023-12-28', first_date - 1 FROM coverage WHERE instrument_id NOT LIKE '%-2' AND first_date > DATE '2023-12-28'
    UNION ALL SELECT instrument_id, 'trailing', last_date + 1, DATE '2024-02-02' FROM coverage WHERE instrument_id NOT LIKE '%-2' AND last_date < DATE '2024-02-02')""")  # fmt: skip
def _(t):
    wanted = t.eod.select("instrument_id").distinct().withColumn("start_date", F.lit("2023-12-28").cast("date")).withColumn("end_date", F.lit("2024-02-02").cast("date"))
    return ingest.coverage_gaps(t.coverage.filter("instrument_id NOT LIKE '%-2'"), wanted)


@plan("covered_through", "SELECT instrument_id, max(date) AS last_bar, CASE WHEN DATE '2001-11-06' - max(date) <= 5 THEN DATE '2001-11-06' ELSE max(date) END AS covered_through FROM long GROUP BY 1")
def _(t):
    return ingest.covered_through(t.long.groupBy("instrument_id").agg(F.max("date").alias("last_bar")), "2001-11-06", 5)


@plan("coverage_extend", "SELECT instrument_id, min(first_date) AS first_date, max(last_date) AS last_date FROM (SELECT instrument_id, first_date, last_date FROM coverage UNION ALL SELECT DISTINCT instrument_id, DATE '2024-01-05', DATE '2024-03-01' FROM eod WHERE instrument_id LIKE '%-3') GROUP BY 1")
def _(t):
    more = t.eod.filter("instrument_id LIKE '%-3'").select("instrument_id").distinct().withColumn("first_date", F.lit("2024-01-05").cast("date")).withColumn("last_date", F.lit("2024-03-01").cast("date"))
    return ingest.coverage_extend(t.coverage, more)


@plan("refresh_validate", """SELECT * FROM (SELECT instrument_id, CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS lost_dates, CAST(count(*) FILTER (WHERE n = 1 AND o = 1 AND (d0 IS DISTINCT FROM d1 OR s0 IS DISTINCT FROM s1)) AS BIGINT) AS changed_actions, CAST(count(*) FILTER (WHERE o IS NULL) AS BIGINT) AS new_dates
    FROM (SELECT instrument_id, date, div_cash AS d0, split_factor AS s0, 1 AS o FROM long) FULL JOIN (SELECT instrument_id, date, div_cash AS d1, split_factor AS s1, 1 AS n FROM redelivery) USING (instrument_id, date) GROUP BY 1)
    WHERE lost_dates + changed_actions + new_dates > 0""")  # fmt: skip
def _(t):
    return ingest.refresh_validate(t.long, t.redelivery)


RANKED = "SELECT *, row_number() OVER (ORDER BY dollar_volume DESC, instrument_id) AS rank FROM (SELECT instrument_id, round(avg(close * volume), 6) AS dollar_volume, CAST(count(*) AS BIGINT) AS days FROM {0} WHERE volume >= 0 GROUP BY 1 HAVING count(*) >= {1}) QUALIFY rank <= {2}"


@plan("universe_rank", f"SELECT instrument_id, dollar_volume, days, CAST(rank AS INTEGER) AS rank FROM ({RANKED.format('long', 100, 25)})")
def _(t):
    return ingest.universe_rank(t.long, 100, 25)


@plan("liquidity_cohort", f"""SELECT instrument_id, dollar_volume, days, CAST(rank AS INTEGER) AS rank FROM ({RANKED.format("(SELECT b.* FROM long b JOIN (SELECT * FROM (SELECT session_date FROM long_sessions WHERE session_date <= DATE '1999-06-30' ORDER BY session_date DESC LIMIT 60)) s ON s.session_date = b.date)", 5, 15)})""")
def _(t):
    return ingest.liquidity_cohort(t.long, t.indexed, "1999-06-30", 60, 5, 15)


NOW = "TIMESTAMP '2024-01-20 12:00:00'"
#: the billing month begins at 05:00 UTC of its first day
USAGE = f"""SELECT CAST(count(*) FILTER (WHERE ts > {NOW} - INTERVAL 1 HOUR) AS BIGINT) AS hourly_requests, CAST(count(*) FILTER (WHERE ts > {NOW} - INTERVAL 1 DAY) AS BIGINT) AS daily_requests, CAST(count(*) AS BIGINT) AS requests,
    CAST(coalesce(sum(observed), 0) AS BIGINT) AS observed_bytes, CAST(coalesce(sum(CASE WHEN settled AND bytes_known THEN observed ELSE greatest(reserved, observed) END), 0) AS BIGINT) AS charged_bytes,
    CAST(count(*) FILTER (WHERE NOT complete) AS BIGINT) AS incomplete_attempts FROM attempts WHERE ts >= TIMESTAMP '2024-01-01 05:00:00'"""


def _attempts(t):
    return t.read("events").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") * 10).alias("reserved"), F.floor("value").alias("observed"),
        (F.col("event_type") == "purchase").alias("settled"), (F.col("user_id") % 2 == 0).alias("bytes_known"), (F.col("event_type") != "view").alias("complete"),
    )


@plan("ledger_usage", USAGE)
def _(t):
    return ingest.ledger_usage(_attempts(t), "2024-01-20 12:00:00")


@plan("request_rate", f"SELECT 'request_rate' AS \"check\", CASE WHEN greatest(hourly_requests / 50, daily_requests / 400) >= 1 THEN 'error' WHEN greatest(hourly_requests / 50, daily_requests / 400) >= 0.8 THEN 'warning' ELSE 'ok' END AS severity, daily_requests AS affected, CAST(400 AS BIGINT) AS total, hourly_requests || '/50' AS detail FROM ({USAGE})")
def _(t):
    return health.request_rate(ingest.ledger_usage(_attempts(t), "2024-01-20 12:00:00"), 50, 400)


TARGETS = "SELECT CASE WHEN c_custkey % 9 = 0 THEN 'current_retry_exhausted' WHEN c_custkey % 4 = 0 THEN 'current_retry_pending' WHEN c_custkey % 4 = 1 THEN 'done' END AS last_status, CAST(c_custkey % 3 AS INTEGER) AS depth, CAST(c_nationkey AS INTEGER) AS turns, c_custkey FROM customer"


def _targets(t):
    k = F.col("c_custkey")
    status = F.when(k % 9 == 0, "current_retry_exhausted").when(k % 4 == 0, "current_retry_pending").when(k % 4 == 1, "done")
    return t.read("customer").select(status.alias("last_status"), (k % 3).alias("successful_depth"), F.col("c_nationkey").alias("attempted_turns"), "c_custkey")


@plan("retry_progress", f"""SELECT 'ongoing_progress' AS "check", CASE WHEN (s + e) / n >= 0.1 THEN 'error' ELSE 'warning' END AS severity, CAST(s + e AS BIGINT) AS affected, CAST(n AS BIGINT) AS total, s || ' stuck ' || e || ' exhausted' AS detail FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE last_status = 'current_retry_pending' AND depth = 0 AND turns >= 5) AS s, count(*) FILTER (WHERE last_status = 'current_retry_exhausted') AS e FROM ({TARGETS})) WHERE s + e > 0""")  # fmt: skip
def _(t):
    return health.retry_progress(_targets(t))


@plan("only_retries_left", f"SELECT CAST(count(*) AS BIGINT) AS active, count(*) > 0 AND count(*) FILTER (WHERE last_status IS DISTINCT FROM 'current_retry_pending') = 0 AS only_retries FROM ({TARGETS}) WHERE c_custkey % 6 <> 0 AND c_custkey % 5 <> 0")
def _(t):
    rows = _targets(t).withColumns({"status": F.when(F.col("c_custkey") % 6 != 0, "active").otherwise("done"), "terminal_blocked": F.col("c_custkey") % 5 == 0})
    return health.only_retries_left(rows)


@plan("exclusions", "SELECT 'ongoing_exclusions' AS \"check\", 'warning' AS severity, CAST(count(*) AS BIGINT) AS affected, CAST(sum(count(*)) OVER () AS BIGINT) AS total, status AS detail FROM (SELECT 'alias_' || status AS status FROM segs WHERE status <> 'resolved') GROUP BY status")
def _(t):
    return health.exclusions(t.segments.filter("status <> 'resolved'").select("ticker", F.concat(F.lit("alias_"), "status").alias("status")))


@plan("unresolved_listings", """SELECT 'unresolved_listings' AS "check", CASE WHEN count(*) FILTER (WHERE u.ticker IS NULL) > 0 THEN 'warning' ELSE 'ok' END AS severity, CAST(count(*) FILTER (WHERE u.ticker IS NULL) AS BIGINT) AS affected, CAST(count(*) AS BIGINT) AS total,
    coalesce(array_to_string(list_slice(list(l.ticker ORDER BY l.ticker) FILTER (WHERE u.ticker IS NULL), 1, 10), ','), '') AS detail
    FROM (SELECT DISTINCT ticker FROM aliases WHERE year(start_date) = 1997) l LEFT JOIN (SELECT ticker FROM aliases WHERE DATE '1997-06-15' BETWEEN start_date AND end_date GROUP BY 1 HAVING count(DISTINCT instrument_id) = 1) u ON u.ticker = l.ticker""")  # fmt: skip
def _(t):
    return health.unresolved_listings(t.aliases.filter(F.year("start_date") == 1997), identity.unique_tickers(t.aliases, "1997-06-15"))


@plan("dominant_asset_type", "SELECT instrument_id, event_type, CAST(n AS BIGINT) AS n FROM (SELECT CAST(user_id AS BIGINT) AS instrument_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY n DESC, event_type) = 1")
def _(t):
    return ingest.dominant(t.read("events").withColumnRenamed("user_id", "instrument_id"), "instrument_id", "event_type")


@plan("session_return", "SELECT instrument_id, CAST(ts AS DATE) AS date, round(arg_max(close, ts) / arg_min(open, ts) - 1, 6) AS session_return FROM hourly GROUP BY 1, 2")
def _(t):
    g = t.hourly.groupBy("instrument_id", F.col("ts").cast("date").alias("date"))
    return g.agg(F.round(exprs.ratio_minus_one(F.max_by("close", "ts"), F.min_by("open", "ts")), 6).alias("session_return"))


@plan("bench_full_scan", "SELECT CAST(count(*) AS BIGINT) AS n, sum(close - open) AS sum_move, CAST(sum(volume) AS BIGINT) AS sum_volume FROM five")
def _(t):
    return t.five.agg(F.count("*").alias("n"), F.sum(F.col("close") - F.col("open")).alias("sum_move"), F.sum("volume").alias("sum_volume"))


@plan("bench_cross_section", "SELECT instrument_id, arg_min(open, ts) AS first_open, arg_max(close, ts) AS last_close, CAST(sum(volume) AS BIGINT) AS volume FROM five WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
def _(t):
    g = t.five.filter(F.col("ts").cast("date") == F.lit("2024-01-10").cast("date")).groupBy("instrument_id")
    return g.agg(F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"), F.sum("volume").alias("volume"))


@plan("bench_one_instrument", "SELECT CAST(count(*) AS BIGINT) AS n, min(low) AS low, max(high) AS high FROM five WHERE instrument_id = 'view-1'")
def _(t):
    return t.five.filter("instrument_id = 'view-1'").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@plan("warehouse_status", " UNION ALL ".join(f"SELECT '{n}' AS dataset_key, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT instrument_id) AS BIGINT) AS instruments, CAST(min({c}) AS DATE) AS first_date, CAST(max({c}) AS DATE) AS last_date FROM {r}" for n, r, c in (("eod", "eod", "date"), ("intraday_1hour", "hourly", "ts"), ("intraday_5min", "five", "ts"))))
def _(t):
    out = None
    for name, df, c in (("eod", t.eod, "date"), ("intraday_1hour", t.hourly, "ts"), ("intraday_5min", t.five, "ts")):
        one = df.agg(F.count("*").alias("n_rows"), F.countDistinct("instrument_id").alias("instruments"), F.min(c).cast("date").alias("first_date"), F.max(c).cast("date").alias("last_date")).withColumn("dataset_key", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@plan("input_manifest_bounds", "SELECT 'lineitem.parquet' AS file, CAST(count(*) AS BIGINT) AS n_rows, min(l_shipdate) AS first_value, max(l_shipdate) AS last_value FROM lineitem")
def _(t):
    return warehouse.file_bounds(t.read("lineitem"), "l_shipdate")


@plan("reconcile_coverage", """SELECT f.instrument_id, f.file_bucket, f.first_bar, f.last_bar, f.n_rows, CASE WHEN f.instrument_id LIKE 'error-%' THEN 'unknown_instrument' WHEN f.file_bucket <> substr(sha256(f.instrument_id), 1, 2) THEN 'wrong_bucket'
    WHEN c.first_date IS NULL THEN 'no_coverage' WHEN f.first_bar < c.first_date OR f.last_bar > c.last_date THEN 'outside_coverage' ELSE 'ok' END AS status
    FROM (SELECT instrument_id, CASE WHEN instrument_id = 'view-1' THEN 'zz' ELSE substr(sha256(instrument_id), 1, 2) END AS file_bucket, min(date) AS first_bar, max(date) AS last_bar, CAST(count(*) AS BIGINT) AS n_rows FROM eod GROUP BY 1) f
    LEFT JOIN (SELECT * FROM coverage WHERE instrument_id NOT LIKE '%-2') c ON c.instrument_id = f.instrument_id""")  # fmt: skip
def _(t):
    files = t.eod.groupBy("instrument_id").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count("*").alias("n_rows"))
    files = files.withColumn("file_bucket", F.when(F.col("instrument_id") == "view-1", "zz").otherwise(exprs.bucket()))
    return ingest.reconcile_coverage(files, t.coverage.filter("instrument_id NOT LIKE '%-2'"), t.eod.filter("instrument_id NOT LIKE 'error-%'").select("instrument_id").distinct())


CAP = "2024-01-24"
_FILES = f"""SELECT instrument_id, 'eod' AS dataset_key, CASE WHEN instrument_id = 'error-3' THEN 'unknown_instrument' ELSE 'ok' END AS status, min(date) AS first_date, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n_rows FROM eod GROUP BY 1
    UNION ALL SELECT instrument_id, 'eod', 'wrong_bucket', min(date), max(date), CAST(count(*) AS BIGINT) FROM eod WHERE instrument_id = 'view-1' AND date > DATE '2024-01-20' GROUP BY 1
    UNION ALL SELECT instrument_id, 'intraday_1hour', status, a, CASE WHEN status = 'ok' THEN least(z, DATE '{CAP}') ELSE z END, CAST(n AS BIGINT) FROM (
      SELECT instrument_id, CASE WHEN instrument_id = 'error-3' THEN 'unknown_instrument' WHEN instrument_id = 'error-1' THEN 'disconnected_years' WHEN min(day) > DATE '{CAP}' THEN 'current_day_only' ELSE 'ok' END AS status, min(day) AS a, max(day) AS z, count(*) AS n
      FROM (SELECT instrument_id, CAST(ts AS DATE) AS day FROM hourly WHERE instrument_id <> 'click-2' OR CAST(ts AS DATE) > DATE '{CAP}'
        UNION ALL SELECT instrument_id, CAST(ts + INTERVAL 2 YEAR AS DATE) FROM hourly WHERE instrument_id = 'error-1') GROUP BY 1)"""


@plan("reconcile_files", _FILES)
def _(t):
    """Coverage from published files with planted faults: a stray file, an unknown instrument, a hole of a year, a last day alone."""
    w = own_warehouse(t, "reconcile")
    w.publish("eod", t.eod)
    hourly = t.hourly.filter(F.expr(f"instrument_id <> 'click-2' OR CAST(ts AS DATE) > DATE'{CAP}'"))
    w.publish("intraday_1hour", hourly.unionByName(t.hourly.filter("instrument_id = 'error-1'").withColumn("ts", F.expr("ts + INTERVAL 2 YEAR"))))
    (stray,) = [f for f in w.pin(["eod"]).files("eod") if f.endswith(f"bucket={warehouse.bucket_of('click-0')}")]
    ingest.canonical(t.eod.filter("instrument_id = 'view-1' AND date > '2024-01-20'")).write.mode("append").parquet(stray)
    return reconcile.judged(w, t.eod.filter("instrument_id <> 'error-3'").select("instrument_id").distinct(), date.fromisoformat(CAP))


@plan("budget_ramp", "SELECT day, CAST(500000 + 500000 * CASE WHEN l >= 7 THEN 0 ELSE 6 - l END // 6 AS BIGINT) AS byte_limit FROM (SELECT DISTINCT date AS day, last_day(date) - date AS l FROM eod)")
def _(t):
    return ingest.budget_ramp(t.eod.select(F.col("date").alias("day")).distinct(), 500_000, 1_000_000, 7)


@plan("cohort_freshness", """SELECT 'coverage_freshness' AS "check", CASE WHEN n = 0 THEN 'ok' WHEN top > 0 OR n >= 0.25 * members THEN 'error' ELSE 'warning' END AS severity, CAST(n AS BIGINT) AS affected, CAST(members AS BIGINT) AS total, 'top ' || top AS detail FROM (
    SELECT count(*) AS members, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE gone AND rank <= 5) AS top FROM (
      SELECT s_suppkey AS rank, NOT EXISTS (SELECT 1 FROM long b WHERE b.instrument_id = 'S' || s_suppkey AND b.instrument_id <> 'S4' AND b.date >= DATE '2001-10-20') AS gone FROM supplier))""")  # fmt: skip
def _(t):
    cover = t.long.filter("instrument_id <> 'S4'").groupBy("instrument_id").agg(F.max("date").alias("last_date"))
    members = t.read("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("instrument_id"), F.col("s_suppkey").alias("rank"))
    return health.coverage_freshness(members, cover, "2001-10-20", 5)


@plan("file_envelope", "SELECT 'events.parquet' AS file, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_type) AS BIGINT) AS instruments, min(event_type) AS instrument_id, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, 'not_one_instrument' AS status FROM events")
def _(t):
    return ingest.envelope(t.read("events").select("_metadata", F.col("event_type").alias("instrument_id"), "ts"), "ts")


@plan("lookahead_rows", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) || 'T00:00:00Z' AS date FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'view'")
def _(t):
    rows = t.read("events").filter("event_type = 'view' AND ts >= '2024-01-08' AND ts < '2024-01-13'").select("event_id", F.concat(F.col("ts").cast("date").cast("string"), F.lit("T00:00:00Z")).alias("date"))
    return ingest.target_rows(rows, "2024-01-08", "2024-01-11", "2024-01-12", 10**9, 10**9)


#: a request holds 128 weekdays of 78 bars, the day it looks ahead included
CHUNKS = """WITH RECURSIVE days AS (
    SELECT day, (SELECT min(s.session_date) FROM long_sessions s WHERE s.session_date > day) AS ahead FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-10', INTERVAL 1 DAY)) AS DATE) AS day)),
  weekdays AS (SELECT day, ahead, sum(CASE WHEN isodow(day) < 6 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS number FROM days),
  known AS MATERIALIZED (SELECT w.day, w.ahead, w.number - CASE WHEN isodow(w.day) < 6 THEN 1 ELSE 0 END AS before, a.number AS through FROM weekdays w JOIN weekdays a ON a.day = w.ahead),
  wanted AS MATERIALIZED (SELECT instrument_id, min(date) AS a, max(date) AS b FROM long GROUP BY 1),
  chunks AS (
    SELECT s.instrument_id, s.b, s.a AS start, max(k.day) AS stop FROM wanted s JOIN known f ON f.day = s.a JOIN known k ON k.day BETWEEN s.a AND s.b AND k.through - f.before <= 128 GROUP BY ALL
    UNION ALL
    SELECT c.instrument_id, c.b, c.stop + 1, max(k.day) FROM chunks c JOIN known f ON f.day = c.stop + 1 JOIN known k ON k.day BETWEEN c.stop + 1 AND c.b AND k.through - f.before <= 128 WHERE c.stop < c.b GROUP BY ALL)
  SELECT instrument_id, c.start, c.stop AS "end", k.ahead AS fetch_end, CAST((k.through - f.before) * 78 AS BIGINT) AS max_rows FROM chunks c JOIN known f ON f.day = c.start JOIN known k ON k.day = c.stop"""


@plan("request_chunks", CHUNKS)
def _(t):
    """The requests that five-minute bars of each instrument's days would take."""
    spans = t.long.groupBy("instrument_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return calendar.chunked(spans, "5min")


@plan("fn_label_format", "SELECT CAST(h AS INTEGER) AS hour, format('{:02d}:00_close_of_{:02d}:00_bar', CAST(h AS INTEGER) + 1, CAST(h AS INTEGER)) AS hour_label, format('{:02d}:{:02d}_close_of_5min_bar', CAST(floor((570 + h * 5) / 60) AS INTEGER), CAST((570 + h * 5) % 60 AS INTEGER)) AS minute_label FROM (SELECT DISTINCT l_linenumber AS h FROM lineitem)")
def _(t):
    h = F.col("hour")
    return t.read("lineitem").select(F.col("l_linenumber").cast("int").alias("hour")).distinct().select("hour", exprs.hour_label(h).alias("hour_label"), exprs.minute_label(h * 5).alias("minute_label"))


@plan("fn_bucket_sha256", "SELECT instrument_id, substr(sha256(instrument_id), 1, 2) AS bucket FROM (SELECT DISTINCT instrument_id FROM long)")
def _(t):
    return t.long.select("instrument_id").distinct().withColumn("bucket", exprs.bucket())


@plan("fn_ny_time_parts", f"SELECT event_id, CAST({oracle.ny('ts')} AS DATE) AS ny_date, CAST(hour({oracle.ny('ts')}) AS INTEGER) AS ny_hour, CAST(minute({oracle.ny('ts')}) AS INTEGER) AS ny_minute, CAST(ts AS DATE) AS utc_date FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp_ntz")
    local = exprs.ny(ts)
    return t.read("events").select("event_id", local.cast("date").alias("ny_date"), F.hour(local).alias("ny_hour"), F.minute(local).alias("ny_minute"), exprs.utc_date(ts).alias("utc_date"))


@plan("listing_scope", "SELECT DISTINCT upper(trim(ticker)) AS ticker, exchange, lower(asset_type) AS asset_type, currency, start_date, end_date FROM listings WHERE exchange IN ('NYSE', 'NASDAQ', 'BATS') AND lower(asset_type) IN ('stock', 'etf') AND currency = 'USD' AND start_date IS NOT NULL AND start_date <= end_date")
def _(t):
    return ingest.listing_scope(t.listings)


@plan("listing_active_in_year", "SELECT * FROM listings WHERE start_date <= DATE '1997-12-31' AND coalesce(end_date, DATE '1997-12-31') >= DATE '1997-01-01'")
def _(t):
    return ingest.active_in_year(t.listings, 1997)
