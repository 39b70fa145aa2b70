"""The study frames behind the registered queries, each built once per query.

Selected events and scoped observations feed several branches of a plan. They are few beside the
bars they come from, so they are kept (in memory, then disk) rather than derived for each branch;
a lost part is derived again. The next query releases them.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions import calendar
from barlake.operators import events, features, identity, ranking, studies
from barlake.plans import settings as S
from barlake.sources.derive import Tables
from barlake.sources.warehouse import Warehouse


_kept: list[DataFrame] = []


def release() -> None:
    """Give up what earlier queries kept; a result of theirs that is still read derives it again."""
    while _kept:
        _kept.pop().unpersist()


def keep(df: DataFrame) -> DataFrame:
    """Hold a frame that several branches of one query read."""
    _kept.append(df.persist())
    return df


def own_warehouse(t: Tables, name: str) -> Warehouse:
    """A warehouse of the query's own in the folder that all executors share."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barlake-publish-")
    return Warehouse(t.spark, f"{folder}/{name}-{t.spark.sparkContext.applicationId}-{uuid.uuid4().hex}")


class Frames(Tables):
    @cached_property
    def feat_l(self) -> DataFrame:
        return features.eod_features(self.long, S.LONG_LOOKBACK)

    @cached_property
    def feat_e(self) -> DataFrame:
        return features.eod_features(self.eod, S.LOOKBACK)

    @cached_property
    def density_h(self) -> DataFrame:
        return features.density(self.eod, self.hourly, calendar.expected_labels(self.sessions, "1hour"), "1hour", S.LOOKBACK)

    @cached_property
    def density_f(self) -> DataFrame:
        return features.density(self.eod, self.five, calendar.expected_labels(self.sessions, "5min"), "5min", S.LOOKBACK)

    @cached_property
    def cand(self) -> DataFrame:
        return studies.gap_candidates(self.feat_e, self.sessions, self.density_h, S.BENCHMARK, S.LOOKBACK, S.GAP, 0.0, S.PERIODS)

    @cached_property
    def chosen(self) -> DataFrame:
        return keep(studies.dense(self.cand, hourly_density=S.DENSITY))

    @cached_property
    def cand_l(self) -> DataFrame:
        none = self.long.select("instrument_id", "date", F.lit(None).cast("double").alias("hourly_density")).limit(0)
        return studies.gap_candidates(self.feat_l, self.long_sessions, none, S.LONG_BENCHMARK, S.LONG_LOOKBACK, S.GAP, 0.0, S.LONG_PERIODS)

    @cached_property
    def obs_gap(self) -> DataFrame:
        return keep(studies.gap_observations(self.chosen, self.hourly, self.eod, self.sessions, S.BENCHMARK, S.TARGET))

    @cached_property
    def obs_open(self) -> DataFrame:
        return keep(studies.opening_observations(self.chosen, self.five, self.hourly, self.sessions, S.BENCHMARK, S.TARGET))

    @cached_property
    def indexed(self) -> DataFrame:
        return calendar.with_index(self.long_sessions)

    @cached_property
    def assets(self) -> DataFrame:
        kind = F.when(F.col("s_nationkey") % 3 == 0, "etf").when(F.col("s_nationkey") % 3 == 1, "stock")
        return self.read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("instrument_id"), kind.alias("asset_type"))

    @cached_property
    def obs_multi(self) -> DataFrame:
        return studies.multiday_observations(self.cand_l, self.long, self.indexed, self.assets, S.LONG_BENCHMARK, S.TARGET)

    @cached_property
    def event_aliases(self) -> DataFrame:
        ids = self.eod.select("instrument_id").distinct()
        span = lambda a, b: [F.lit(a).cast("date").alias("start_date"), F.lit(b).cast("date").alias("end_date")]
        first = ids.select("instrument_id", F.concat(F.lit("A-"), "instrument_id").alias("ticker"), *span("2024-01-01", "2024-01-25"))
        return first.unionByName(ids.filter("instrument_id LIKE '%-1'").select("instrument_id", F.concat(F.lit("B-"), "instrument_id").alias("ticker"), *span("2024-01-10", "2024-01-12")))

    @cached_property
    def evidence(self) -> DataFrame:
        start = F.col("o_orderdate").cast("date")
        state = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "unverified").otherwise("rejected")
        own, ticker = F.col("o_custkey") + F.col("o_orderkey") % 2, F.col("o_custkey") + F.col("o_orderkey") % 3
        identifier = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("vendor:V"), own)).otherwise(F.concat(F.lit("ticker:T"), F.col("o_custkey") + F.col("o_orderkey") % 7 % 3))
        return self.read("orders").select(
            F.concat(F.lit("S"), F.col("o_custkey")).alias("instrument_id"), identifier.alias("identifier"), F.concat(F.lit("t"), ticker).alias("name"),
            start.alias("start_date"), F.date_add(start, 30).alias("end_date"), state.alias("state"),
        ).distinct()

    @cached_property
    def complete(self) -> DataFrame:
        bars = self.eod.filter("volume > 2").select("instrument_id", F.col("date").alias("label"))
        return events.lookback_complete(keep(self.cand), bars, self.sessions, "lookback_start_date", "prior_date")

    @cached_property
    def audit(self) -> DataFrame:
        return events.eligibility_audit(self.cand, self.event_aliases, self.sessions, self.complete)

    @cached_property
    def scoped(self) -> DataFrame:
        # A ranking reads one checkpoint: only that horizon is observed.
        at_close = studies.multiday_observations(self.cand_l, self.long, self.indexed, self.assets, S.LONG_BENCHMARK, S.TARGET, (0,))
        rows = ranking.scope(at_close, "session_plus_0")
        return keep(rows.select("instrument_id", "event_date", "period", "adv_dollars", "measured_return", "excess_return", "reached_target_at_checkpoint"))

    @cached_property
    def pairs(self) -> DataFrame:
        return keep(ranking.walk_forward(self.scoped, 2))

    @cached_property
    def ranked(self) -> DataFrame:
        return keep(ranking.select_candidates(self.scoped, self.pairs, S.MIN_EVENTS, S.MIN_LIFT))

    @cached_property
    def evaluated(self) -> DataFrame:
        return ranking.evaluate_candidates(self.scoped, self.pairs, self.ranked.filter("selected"))

    @cached_property
    def two_pass(self) -> DataFrame:
        return ranking.evaluation_summary(self.scoped, self.pairs, self.evaluated)

    @cached_property
    def tags(self) -> DataFrame:
        return self.read("supplier").filter("s_nationkey % 4 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("instrument_id"), F.concat(F.lit("G"), F.col("s_nationkey") % 5).alias("group"))

    def _delivery(self, held: DataFrame) -> DataFrame:
        """The held bars from the sixth of each month on, changed, and new days for all instruments."""
        day = F.dayofmonth("date")
        changed = held.filter(day > 5).withColumns({"open": F.col("open") + 1, "high": F.col("high") + 1, "div_cash": F.when(day == 9, 9.0).otherwise(F.col("div_cash"))})
        return changed.unionByName(self.long.filter(day == 8).withColumn("date", F.date_add("date", 4000)))

    @cached_property
    def incoming(self) -> DataFrame:
        """A later delivery: changed bars of the funds, and new days for all."""
        return self._delivery(self.long.join(self.funds, "instrument_id", "left_semi"))

    @cached_property
    def funds(self) -> DataFrame:
        return self.assets.filter("asset_type = 'etf'").select("instrument_id")

    @cached_property
    def redelivery(self) -> DataFrame:
        """A later delivery of all instruments, which changes, loses and adds bars by day."""
        return self._delivery(self.long)

    @cached_property
    def gaps(self) -> DataFrame:
        return identity.episode_gaps(self.long, self.indexed, S.EPISODE_GAP)

    @cached_property
    def ranges(self) -> DataFrame:
        return self.aliases.select("instrument_id", "start_date", "end_date").distinct()

    @cached_property
    def segments(self) -> DataFrame:
        return identity.alias_segments(self.aliases, "1996-01-01", "1997-12-31")

    @cached_property
    def listings(self) -> DataFrame:
        k = F.col("c_custkey")
        start = F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000).cast("int"))
        return self.read("customer").select(
            F.concat(F.lit(" t"), k % 60, F.lit(" ")).alias("ticker"),
            F.when(k % 4 == 0, "NYSE").when(k % 4 == 1, "NASDAQ").when(k % 4 == 2, "LSE").otherwise("BATS").alias("exchange"),
            F.when(F.col("c_nationkey") % 3 == 0, "Stock").when(F.col("c_nationkey") % 3 == 1, "ETF").otherwise("Mutual Fund").alias("asset_type"),
            F.when(F.col("c_mktsegment") == "BUILDING", "EUR").otherwise("USD").alias("currency"),
            F.when(k % 11 == 0, F.lit(None)).otherwise(start).alias("start_date"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000 + F.col("c_nationkey") * 40 - 100).cast("int")).alias("end_date"),
        )
