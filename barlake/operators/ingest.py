"""Kernels of ingestion: canonical frames, keyed merges, coverage arithmetic and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The canonical columns and types, and the vendor's names for them.
KEY = ["instrument_id", "date"]
EOD_SCHEMA = T.StructType(
    [T.StructField("instrument_id", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType())]
    + [T.StructField(f"adj_{c}", T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("adj_volume", T.LongType()), T.StructField("div_cash", T.DoubleType()), T.StructField("split_factor", T.DoubleType())]
)
INTRADAY_SCHEMA = T.StructType(
    [T.StructField("instrument_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType())]
)
BILLING_HOURS = 5
VENDOR = {"adjOpen": "adj_open", "adjHigh": "adj_high", "adjLow": "adj_low", "adjClose": "adj_close", "adjVolume": "adj_volume", "divCash": "div_cash", "splitFactor": "split_factor"}


def canonical(df: DataFrame, schema: T.StructType = EOD_SCHEMA) -> DataFrame:
    """The schema's columns in order and type; any other set of columns is an error."""
    if set(df.columns) != set(schema.names):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(schema.names))}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def normalize_eod(rows: DataFrame, instrument: str | None = None) -> DataFrame:
    """Vendor rows (text dates with a time, camel-case names) as canonical daily bars."""
    df = rows.withColumnsRenamed(VENDOR).withColumn("date", F.to_date(F.substring("date", 1, 10)))
    return canonical(df.withColumn("instrument_id", F.lit(instrument)) if instrument else df)


def duplicate_conflicts(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(rows, distinct_rows, conflicting_keys, null_keys): exact copies collapse, conflicts are errors."""
    exact = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    per = exact.groupBy(*key).agg(F.sum("copies").alias("rows"), F.count("*").alias("versions"))
    unknown = F.lit(False)
    for k in key:
        unknown = unknown | F.col(k).isNull()
    return per.agg(F.sum("rows").alias("rows"), F.sum("versions").alias("distinct_rows"), F.count_if(F.col("versions") > 1).alias("conflicting_keys"), F.count_if(unknown).alias("null_keys"))


def repeated_keys(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(repeated_keys, null_keys) from the keys alone, which is all that moves."""
    unknown = F.lit(False)
    for k in key:
        unknown = unknown | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(unknown).alias("null_keys"))


def merge_upsert(existing: DataFrame, incoming: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of both, the incoming one where keys meet."""
    both = existing.withColumn("incoming", F.lit(0)).unionByName(incoming.withColumn("incoming", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("incoming"))
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "incoming")


def snapshot_replace(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace everything their instruments had."""
    kept = existing.join(incoming.select("instrument_id").distinct(), "instrument_id", "left_anti")
    return kept.unionByName(incoming)


def coverage_gaps(coverage: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parts of the wanted span before and after what is covered; all of it without coverage."""
    rows = wanted.join(coverage.select("instrument_id", "first_date", "last_date"), "instrument_id", "left")
    none = F.col("first_date").isNull()
    parts = F.array(
        F.when(none, F.struct(F.lit("whole").alias("part"), F.col("start_date").alias("start_date"), F.col("end_date").alias("end_date"))),
        F.when(~none & (F.col("start_date") < F.col("first_date")), F.struct(F.lit("leading").alias("part"), F.col("start_date"), F.least("end_date", F.date_sub("first_date", 1)).alias("end_date"))),
        F.when(~none & (F.col("end_date") > F.col("last_date")), F.struct(F.lit("trailing").alias("part"), F.greatest("start_date", F.date_add("last_date", 1)).alias("start_date"), F.col("end_date"))),
    )
    return rows.select("instrument_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p")).select("instrument_id", "p.*")


def covered_through(last_bars: DataFrame, requested: str, lag_days: int) -> DataFrame:
    """Through which day a request counts as covered: bars within the publication lag of its end count for it."""
    end = F.lit(requested).cast("date")
    through = F.when(F.col("last_bar").isNull(), F.lit(None).cast("date")).when(F.datediff(end, "last_bar") <= lag_days, end).otherwise(F.col("last_bar"))
    return last_bars.select("instrument_id", "last_bar", through.alias("covered_through"))


def coverage_extend(coverage: DataFrame, more: DataFrame) -> DataFrame:
    """Widen each instrument's span to hold both."""
    both = coverage.select("instrument_id", "first_date", "last_date").unionByName(more.select("instrument_id", "first_date", "last_date"))
    return both.groupBy("instrument_id").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def refresh_validate(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """What a full refresh would lose or change: (instrument_id, lost_dates, changed_actions, new_dates)."""
    a = stored.select(*KEY, F.col("div_cash").alias("d0"), F.col("split_factor").alias("s0"), F.lit(1).alias("old"))
    b = fresh.select(*KEY, F.col("div_cash").alias("d1"), F.col("split_factor").alias("s1"), F.lit(1).alias("new"))
    rows = a.join(b, KEY, "full")
    changed = F.col("old").isNotNull() & F.col("new").isNotNull() & (~F.col("d0").eqNullSafe(F.col("d1")) | ~F.col("s0").eqNullSafe(F.col("s1")))
    out = rows.groupBy("instrument_id").agg(F.count_if(F.col("new").isNull()).alias("lost_dates"), F.count_if(changed).alias("changed_actions"), F.count_if(F.col("old").isNull()).alias("new_dates"))
    return out.filter("lost_dates + changed_actions + new_dates > 0")


def universe_rank(bars: DataFrame, least_days: int, top: int) -> DataFrame:
    """Instruments by mean dollar volume, ties to the smaller id; only the top is sorted whole."""
    mean = bars.filter("volume >= 0").groupBy("instrument_id").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume"), F.count("*").alias("days"))
    best = mean.filter(F.col("days") >= least_days).withColumn("dollar_volume", F.round("dollar_volume", 6)).orderBy(F.desc("dollar_volume"), "instrument_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dollar_volume"), "instrument_id")))


def liquidity_cohort(bars: DataFrame, indexed: DataFrame, asof: str, last: int, least: int, top: int) -> DataFrame:
    """The ranking over the last sessions up to a day."""
    days = indexed.filter(F.col("session_date") <= F.lit(asof).cast("date")).orderBy(F.desc("session_date")).limit(last)
    recent = bars.join(F.broadcast(days.select(F.col("session_date").alias("date"))), "date", "left_semi")
    return universe_rank(recent, least, top)


def ledger_usage(attempts: DataFrame, now: str) -> DataFrame:
    """Requests and bytes of the billing month that holds ``now`` (UTC), and its last hour and day.

    The month is that of the billing clock, BILLING_HOURS behind UTC all year. An attempt whose bytes are settled and known is charged what was observed,
    any other the larger of that and its reservation. Attempts before the month count nowhere.
    """
    at = F.lit(now).cast("timestamp_ntz")
    behind = F.expr(f"INTERVAL {BILLING_HOURS} HOUR")
    month = F.trunc((at - behind).cast("date"), "month").cast("timestamp_ntz") + behind
    charged = F.when(F.col("settled") & F.col("bytes_known"), F.col("observed")).otherwise(F.greatest("reserved", "observed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return attempts.filter(F.col("ts") >= month).agg(
        F.count_if(F.col("ts") > at - F.expr("INTERVAL 1 HOUR")).alias("hourly_requests"), F.count_if(F.col("ts") > at - F.expr("INTERVAL 1 DAY")).alias("daily_requests"),
        F.count("*").alias("requests"), total(F.col("observed")).alias("observed_bytes"), total(charged).alias("charged_bytes"), F.count_if(~F.col("complete")).alias("incomplete_attempts"),
    )


def dominant(records: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smaller."""
    n = records.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).filter("r = 1").select(key, value, "n")


def reconcile_coverage(files: DataFrame, coverage: DataFrame, known: DataFrame) -> DataFrame:
    """Files against coverage: wrong bucket, unknown instrument, or a span the coverage doesn't say."""
    rows = files.join(coverage.select("instrument_id", "first_date", "last_date"), "instrument_id", "left").join(known.select("instrument_id", F.lit(1).alias("known")), "instrument_id", "left")
    status = (
        F.when(F.col("known").isNull(), "unknown_instrument").when(F.col("file_bucket") != F.substring(F.sha2("instrument_id", 256), 1, 2), "wrong_bucket")
        .when(F.col("first_date").isNull(), "no_coverage").when((F.col("first_bar") < F.col("first_date")) | (F.col("last_bar") > F.col("last_date")), "outside_coverage").otherwise("ok")
    )
    return rows.select("instrument_id", "file_bucket", "first_bar", "last_bar", "n_rows", status.alias("status"))


def budget_ramp(days: DataFrame, base: int, maximum: int, ramp_days: int) -> DataFrame:
    """The byte limit of a billing day: the base, rising by equal steps over the month's last days to the maximum.

    The first of the ``ramp_days`` last days still has the base, the last has the maximum.
    """
    if ramp_days < 2 or maximum < base:
        raise ValueError("a ramp spans two days at least and rises")
    left = F.datediff(F.last_day("day"), "day")
    step = F.greatest(F.lit(0), F.lit(ramp_days - 1) - left).cast("long")
    return days.select("day", (F.lit(base) + F.floor(F.lit(maximum - base) * step / F.lit(ramp_days - 1))).cast("long").alias("byte_limit"))


def envelope(bars: DataFrame, column: str) -> DataFrame:
    """(file, n_rows, instruments, instrument_id, first, last, status) of each file read.

    A file holds one instrument, and for timestamps one year.
    """
    day = F.col(column).cast("date")
    rows = bars.select(F.col("_metadata.file_name").alias("file"), "instrument_id", day.alias("day"))
    per = rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.countDistinct("instrument_id").alias("instruments"), F.min("instrument_id").alias("instrument_id"), F.min("day").alias("first"), F.max("day").alias("last"))
    years = F.lit(column == "ts") & (F.year("first") != F.year("last"))
    status = F.when(F.col("instruments") != 1, "not_one_instrument").when(F.col("first").isNull(), "no_dates").when(years, "several_years").otherwise("ok")
    return per.withColumn("status", status)


def target_rows(rows: DataFrame, start: str, end: str, fetch_end: str, max_rows: int, cap: int = 10_000) -> DataFrame:
    """Rows of an answer that lie in [start, end]; those up to ``fetch_end`` were fetched to look ahead.

    An answer at the cap may be cut off, one beyond the planned ``max_rows`` or with a row outside the
    fetched days is not what was asked for: each is an error.
    """
    day, lo, hi, until = F.to_date(F.substring("date", 1, 10)), *(F.lit(d).cast("date") for d in (start, end, fetch_end))
    held = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(day.between(lo, until), F.lit(False))).alias("outside")).first()
    if held.n >= cap or held.n > max_rows:
        raise ValueError(f"the answer has {held.n} rows; at most {min(cap - 1, max_rows)} are whole")
    if held.outside:
        raise ValueError(f"{held.outside} rows lie outside {start}..{fetch_end}")
    return rows.filter(day <= hi)


def listing_scope(listings: DataFrame) -> DataFrame:
    """US stocks and funds in dollars with valid dates, names upper-cased, exact copies dropped."""
    rows = listings.select(F.upper(F.trim("ticker")).alias("ticker"), "exchange", F.lower("asset_type").alias("asset_type"), "currency", "start_date", "end_date")
    ok = F.col("exchange").isin("NYSE", "NASDAQ", "BATS", "AMEX", "NYSE ARCA") & F.col("asset_type").isin("stock", "etf") & (F.col("currency") == "USD")
    return rows.filter(ok & (F.col("ticker") != "") & F.col("start_date").isNotNull() & (F.col("start_date") <= F.col("end_date"))).distinct()


def active_in_year(listings: DataFrame, year: int) -> DataFrame:
    first, last = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")
    return listings.filter((F.col("start_date") <= last) & (F.coalesce("end_date", last) >= first))


def universe_import(rows: DataFrame) -> DataFrame:
    """(year, ticker, rank, dollar_volume, conflicts) from lines of (line, year, ticker, rank, dollar_volume).

    Tickers are trimmed and upper-cased; an empty one is an error. Of lines that disagree on a ticker
    the one with the larger volume stays, an unknown one counting 0, the first of equals. If any rank
    of a year is unknown, the whole year is ranked by volume, ties in the order of the lines.
    """
    name = F.upper(F.trim("ticker"))
    checked = F.when(F.coalesce(name == "", F.lit(True)), F.raise_error(F.concat(F.lit("empty ticker in line "), F.col("line").cast("string")))).otherwise(name)
    volume = F.coalesce("dollar_volume", F.lit(0.0))
    best = F.max_by(F.struct("rank", "dollar_volume"), F.struct(volume, -F.col("line")))
    one = rows.withColumn("ticker", checked).groupBy("year", "ticker").agg(best.alias("kept"), F.min("line").alias("line"), F.countDistinct(F.struct("rank", "dollar_volume")).alias("versions"))
    one = one.select("year", "ticker", "line", "kept.*", (F.col("versions") - 1).alias("conflicts"))
    by_volume = F.row_number().over(Window.partitionBy("year").orderBy(F.coalesce("dollar_volume", F.lit(0.0)).desc(), "line"))
    unknown = F.max(F.col("rank").isNull()).over(Window.partitionBy("year"))
    return one.select("year", "ticker", F.when(unknown, by_volume).otherwise(F.col("rank")).cast("int").alias("rank"), "dollar_volume", "conflicts")
