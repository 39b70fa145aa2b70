"""Bars, aliases and observations derived from the generic tables; prices are whole cents.

Daily bars with long history come from ``lineitem`` (an instrument for each supplier), a coherent
trio of daily, hourly and five-minute bars from ``events``.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import calendar

BENCHMARK = "view-0"
EVENT_START, EVENT_END = date(2024, 1, 1), date(2024, 1, 31)
LONG_START, LONG_END = date(1995, 1, 1), date(2001, 12, 31)
ROWS_EACH = 150_000  # of lineitem in one task of a step by instrument


def ohlc(priced: DataFrame, keys: list[str], order: Column, volume: Column) -> DataFrame:
    """Open, high, low, close and volume of each group; first and last by a unique order."""
    p = F.col("price")
    return priced.groupBy(*keys).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), volume.cast("long").alias("volume")
    )


class Tables:
    """The generic tables of one folder and what is derived from them, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def partitions(self) -> int | None:
        """Tasks of a step by instrument, as many as the items need; None where the session's number is enough."""
        needed = -(-self.read("lineitem").count() // ROWS_EACH)
        return needed if needed > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    def by_instrument(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by instrument, in partitions that don't grow with the tables; Spark drops a repetition."""
        return rows.repartition(*filter(None, [self.partitions]), "instrument_id")

    @cached_property
    def long(self) -> DataFrame:
        """Daily bars of suppliers; returned goods make no volume, rare flags make corporate actions.

        Items are dealt by instrument once: the aggregate and all windows by instrument over it need no
        further exchange, and a window in the order of days finds the aggregate's order.
        """
        items = self.read("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("instrument_id"), F.col("l_shipdate").cast("date").alias("date"),
            F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("price"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"), "l_quantity", "l_returnflag", "l_tax", "l_discount",
        )
        volume = F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0))
        div = F.max(F.when((F.col("l_tax") >= 0.08) & (F.col("l_returnflag") == "A"), 0.5).otherwise(0.0))
        split = F.max(F.when((F.col("l_discount") >= 0.10) & (F.col("l_quantity") < 2), 2.0).otherwise(1.0))
        p = F.col("price")
        bars = self.by_instrument(items).groupBy("instrument_id", "date").agg(
            F.min_by(p, "k").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "k").alias("close"),
            volume.cast("long").alias("volume"), div.alias("div_cash"), split.alias("split_factor"),
        )
        return with_adjusted(bars)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.concat(F.col("event_type"), F.lit("-"), F.col("user_id") % 4).alias("instrument_id"), F.col("ts").cast("timestamp_ntz").alias("at"),
            F.round(F.col("value") * 100).cast("double").alias("price"), F.struct("ts", "event_id").alias("k"), "value",
        )

    def _event_bars(self, name: str, when: Column) -> DataFrame:
        return ohlc(self.ticks.withColumn(name, when), ["instrument_id", name], F.col("k"), F.count_if(F.col("value") >= 25))

    @cached_property
    def eod(self) -> DataFrame:
        return with_adjusted(self._event_bars("date", F.col("at").cast("date")).withColumn("div_cash", F.lit(0.0)).withColumn("split_factor", F.lit(1.0)))

    @cached_property
    def hourly(self) -> DataFrame:
        return self._event_bars("ts", F.expr("CAST(date_trunc('HOUR', at) AS TIMESTAMP_NTZ)"))

    @cached_property
    def five(self) -> DataFrame:
        minutes = F.minute("at") % 5
        return self._event_bars("ts", F.expr("CAST(date_trunc('MINUTE', at) AS TIMESTAMP_NTZ)") - F.make_dt_interval(mins=minutes))

    @cached_property
    def dirty(self) -> DataFrame:
        """Long bars with known faults on some days of the month."""
        day = F.dayofmonth("date")
        bars = self.long.withColumns(
            {
                "high": F.when(day == 2, F.col("low") - 1).otherwise(F.col("high")),
                "volume": F.when(day == 3, -F.col("volume") - 1).otherwise(F.col("volume")),
                "close": F.when(day == 4, F.lit(None)).otherwise(F.col("close")),
                "split_factor": F.when(day == 5, 0.0).otherwise(F.col("split_factor")),
                "div_cash": F.when(day == 6, -1.0).otherwise(F.col("div_cash")),
                "adj_low": F.when(day == 7, F.col("adj_high") + 1).otherwise(F.col("adj_low")),
            }
        )
        # The bars of a month's first day stand twice; the bars are derived once.
        return bars.withColumn("copy", F.explode(F.when(day == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")

    @cached_property
    def sessions(self) -> DataFrame:
        return calendar.session_schedule(self.spark, EVENT_START, EVENT_END)

    @cached_property
    def long_sessions(self) -> DataFrame:
        return calendar.session_schedule(self.spark, LONG_START, LONG_END)

    @cached_property
    def all_sessions(self) -> DataFrame:
        """The sessions of both sets of bars."""
        return self.long_sessions.unionByName(self.sessions)

    @cached_property
    def aliases(self) -> DataFrame:
        """Ticker spans of 30 days from orders: renames, reuse, gaps and overlaps all occur.

        An instrument has three tickers and a ticker three instruments at most, whatever the scale.
        """
        start = F.col("o_orderdate").cast("date")
        return self.read("orders").select(
            F.concat(F.lit("S"), F.col("o_custkey")).alias("instrument_id"), F.concat(F.lit("T"), F.col("o_custkey") + F.col("o_orderkey") % 3).alias("ticker"),
            start.alias("start_date"), F.date_add(start, 30).alias("end_date"),
        ).distinct()

    @cached_property
    def coverage(self) -> DataFrame:
        """Known spans of daily event bars; some reach days beyond the bars, one id has none."""
        wide = F.length("instrument_id") % 2
        return self.eod.groupBy("instrument_id").agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
            "instrument_id", F.lit("eod").alias("dataset_key"), F.date_sub("a", (wide * 3).cast("int")).alias("first_date"), F.date_add("b", (wide * 4).cast("int")).alias("last_date")
        )


def with_adjusted(bars: DataFrame) -> DataFrame:
    """Adjusted columns equal to the raw ones, in the canonical order."""
    return bars.select(
        "instrument_id", "date", "open", "high", "low", "close", "volume",
        *[F.col(c).alias(f"adj_{c}") for c in ("open", "high", "low", "close", "volume")], "div_cash", "split_factor",
    )
