"""Aliases, evidence, interval algebra and listing episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import episodes, identity
from barlake.plans import settings as S
from barlake.plans.oracle import weekend
from barlake.plans.registry import plan


@plan("alias_asof", "SELECT b.instrument_id, b.date, b.close, (SELECT CASE WHEN count(DISTINCT a.ticker) = 1 THEN min(a.ticker) END FROM aliases a WHERE a.instrument_id = b.instrument_id AND b.date BETWEEN a.start_date AND a.end_date) AS ticker FROM long b")
def _(t):
    return identity.alias_asof(t.long.select("instrument_id", "date", "close"), t.aliases)


@plan("alias_segments", "SELECT * FROM segs")
def _(t):
    return t.segments


@plan("identifier_segments", """SELECT instrument_id, first, last, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN state ELSE 'unverified' END AS status FROM (
    SELECT p.instrument_id, p.first, p.last, count(DISTINCT CASE WHEN e.state <> 'unverified' THEN e.state END) AS n, min(CASE WHEN e.state <> 'unverified' THEN e.state END) AS state FROM (
      SELECT instrument_id, first, lead(first) OVER (PARTITION BY instrument_id ORDER BY first) - 1 AS last FROM (SELECT DISTINCT instrument_id, unnest([start_date, end_date + 1]) AS first FROM evidence)) p
    JOIN evidence e ON e.instrument_id = p.instrument_id AND e.start_date <= p.first AND e.end_date >= p.last WHERE p.last IS NOT NULL GROUP BY 1, 2, 3)""")  # fmt: skip
def _(t):
    return identity.identifier_segments(t.evidence)


@plan("identifier_ranges", "SELECT * FROM claims")
def _(t):
    spans = t.segments.filter("status = 'resolved'").select(F.col("owner").alias("instrument_id"), F.col("first").alias("start_date"), F.col("last").alias("end_date")).distinct()
    return identity.identifier_ranges(t.evidence, spans)


#: parts of owned spans, without the gaps that two ready parts of one identifier have between them
PLANNED = f"""SELECT * FROM (SELECT *, lag(row(status, identifier)) OVER w AS before, lead(row(status, identifier)) OVER w AS after FROM (
    SELECT o.ticker, o.span_start, c.first, c.last, c.instrument_id, c.identifier, CASE WHEN c.status = 'zero_matches' AND {weekend('c.first', 'c.last')} THEN 'non_session_gap'
      WHEN c.status = 'resolved' AND c.identifier LIKE 'ticker:%' AND upper(substr(c.identifier, 8)) <> o.ticker THEN 'identifier_alias_mismatch' WHEN c.status = 'resolved' THEN 'ready' ELSE 'identifier_' || c.status END AS status
    FROM owned o JOIN claims c ON c.instrument_id = o.instrument_id AND c.span_start = o.span_start AND c.span_end = o.span_end) WINDOW w AS (PARTITION BY ticker, span_start ORDER BY first))
    WHERE NOT (status = 'non_session_gap' AND before IS NOT DISTINCT FROM after AND before[1] IS NOT DISTINCT FROM 'ready')"""


@plan("plan_segments", f"""SELECT ticker, first, last, CASE WHEN status = 'zero' AND {weekend('first', 'last')} THEN 'non_session_gap' ELSE 'alias_' || status END AS status, NULL AS instrument_id, NULL AS identifier FROM segs WHERE status <> 'resolved'
    UNION ALL SELECT ticker, min(first), max(last), status, instrument_id, identifier FROM (
      SELECT *, sum(CASE WHEN status = 'ready' AND last_status = 'ready' AND last_identifier = identifier THEN 0 ELSE 1 END) OVER (PARTITION BY ticker, span_start ORDER BY first) AS run FROM (
        SELECT *, lag(status) OVER w AS last_status, lag(identifier) OVER w AS last_identifier FROM ({PLANNED}) WINDOW w AS (PARTITION BY ticker, span_start ORDER BY first)))
    GROUP BY ticker, span_start, run, status, instrument_id, identifier""")  # fmt: skip
def _(t):
    return identity.plan_segments(t.aliases, t.evidence, "1996-01-01", "1997-12-31")


@plan("metadata_agreement", """SELECT l.ticker, concat_ws(',', CASE WHEN m.ticker IS NULL THEN 'ticker' END, CASE WHEN l.exchange IS DISTINCT FROM m.exchange THEN 'exchange' END, CASE WHEN l.start_date IS DISTINCT FROM m.start_date THEN 'start_date' END,
    CASE WHEN NOT coalesce(l.end_date - m.end_date BETWEEN 0 AND 7, false) THEN 'end_date' END) AS mismatches
    FROM (SELECT 'T' || s_suppkey AS ticker, 'NYSE' AS exchange, DATE '1995-01-01' AS start_date, DATE '2001-01-01' + CAST(s_nationkey AS INTEGER) AS end_date FROM supplier) l
    LEFT JOIN (SELECT 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 7 = 0 THEN 'AMEX' ELSE 'NYSE' END AS exchange, CASE WHEN s_suppkey % 8 = 0 THEN DATE '1996-01-01' ELSE DATE '1995-01-01' END AS start_date, DATE '2001-01-08' AS end_date FROM supplier WHERE s_suppkey % 9 <> 0) m ON m.ticker = l.ticker""")  # fmt: skip
def _(t):
    k, day = F.col("s_suppkey"), lambda text: F.lit(text).cast("date")
    ticker = F.concat(F.lit("T"), k).alias("ticker")
    archive = t.read("supplier").select(ticker, F.lit("NYSE").alias("exchange"), day("1995-01-01").alias("start_date"), F.date_add(day("2001-01-01"), F.col("s_nationkey")).alias("end_date"))
    found = t.read("supplier").filter(k % 9 != 0).select(F.lower(ticker).alias("ticker"), F.when(k % 7 == 0, "AMEX").otherwise("NYSE").alias("exchange"), F.when(k % 8 == 0, day("1996-01-01")).otherwise(day("1995-01-01")).alias("start_date"), day("2001-01-08").alias("end_date"))
    return identity.metadata_agrees(archive, found)


SPAN = ("1996-01-01", "1996-06-30")
COVER = f"SELECT instrument_id, CAST(count(*) FILTER (WHERE NOT {weekend('a', 'b')}) AS BIGINT) AS n_gaps, count(*) FILTER (WHERE NOT {weekend('a', 'b')}) = 0 AS covered FROM cover_gaps GROUP BY 1"


@plan("interval_cover", COVER)
def _(t):
    return identity.interval_cover(t.ranges, *SPAN)


@plan("identifier_resolve", f"""WITH inside AS (SELECT * FROM evidence WHERE start_date <= DATE '1996-02-15' AND end_date >= DATE '1996-02-01'),
    vcut AS (SELECT DISTINCT instrument_id, greatest(start_date, DATE '1996-02-01') AS s, least(end_date, DATE '1996-02-15') AS e, start_date FROM inside WHERE state = 'validated'),
    vg AS (SELECT instrument_id, coalesce(max(e) OVER (PARTITION BY instrument_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '1996-01-31') + 1 AS a, s - 1 AS b FROM vcut
      UNION ALL SELECT instrument_id, max(e) + 1, DATE '1996-02-15' FROM vcut GROUP BY 1)
    SELECT c.instrument_id, c.owners, CASE WHEN c.owners > 1 THEN 'conflict' WHEN coalesce(g.ok, false) THEN 'resolved' ELSE 'incomplete' END AS status
    FROM (SELECT i.instrument_id, CAST(max(o.n) AS BIGINT) AS owners FROM inside i JOIN (SELECT identifier, count(DISTINCT instrument_id) AS n FROM inside GROUP BY 1) o ON o.identifier = i.identifier GROUP BY 1) c
    LEFT JOIN (SELECT instrument_id, count(*) FILTER (WHERE NOT {weekend('a', 'b')}) = 0 AS ok FROM vg GROUP BY 1) g ON g.instrument_id = c.instrument_id""")  # fmt: skip
def _(t):
    return identity.identifier_resolve(t.evidence, "1996-02-01", "1996-02-15")


@plan("merge_ranges", "SELECT instrument_id, min(start_date) AS start_date, max(end_date) AS end_date, CAST(count(*) AS BIGINT) AS n_ranges FROM (SELECT *, sum(CASE WHEN coalesce(start_date > reach + 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM reach) GROUP BY instrument_id, island")
def _(t):
    return identity.merge_ranges(t.ranges)


@plan("coalesce_segments", f"SELECT instrument_id, min(start_date) AS start_date, max(end_date) AS end_date, CAST(count(*) AS BIGINT) AS n_segments FROM (SELECT *, sum(CASE WHEN coalesce(NOT {weekend('(reach + 1)', '(start_date - 1)')}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM reach) GROUP BY instrument_id, island")
def _(t):
    return identity.coalesce_segments(t.ranges)


@plan("universe_resolve", """SELECT u.year, u.ticker, CAST(count(DISTINCT a.instrument_id) AS BIGINT) AS n_instruments, CASE count(DISTINCT a.instrument_id) WHEN 1 THEN 'resolved' WHEN 0 THEN 'unresolved' ELSE 'ambiguous' END AS status
    FROM universe u LEFT JOIN aliases a ON a.ticker = u.ticker AND year(a.start_date) <= u.year AND year(a.end_date) >= u.year GROUP BY 1, 2""")  # fmt: skip
def _(t):
    wanted = t.aliases.select(F.year("start_date").alias("year"), "ticker").distinct().union(t.spark.sql("SELECT 1996, 'NONE'"))
    return identity.universe_resolve(wanted, t.aliases)


@plan("unique_tickers_asof", "SELECT ticker, min(instrument_id) AS instrument_id FROM aliases WHERE DATE '1997-06-15' BETWEEN start_date AND end_date GROUP BY 1 HAVING count(DISTINCT instrument_id) = 1")
def _(t):
    return identity.unique_tickers(t.aliases, "1997-06-15")


@plan("latest_alias", "SELECT instrument_id, ticker FROM aliases QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY end_date DESC, start_date DESC, ticker) = 1")
def _(t):
    return identity.latest_alias(t.aliases)


@plan("archive_effective", "SELECT instrument_id AS anchor, ticker, start_date, end_date FROM aliases QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY end_date DESC, start_date DESC, ticker DESC) = 1")
def _(t):
    return identity.archive_effective(t.aliases.withColumnRenamed("instrument_id", "anchor"))


@plan("archive_overlaps", "SELECT * FROM (SELECT a.ticker, a.instrument_id AS anchor_a, b.instrument_id AS anchor_b, greatest(a.start_date, b.start_date) AS start_date, least(a.end_date, b.end_date) AS end_date FROM aliases a JOIN aliases b ON a.ticker = b.ticker AND a.instrument_id < b.instrument_id) WHERE start_date <= end_date")
def _(t):
    return identity.archive_overlaps(t.aliases.withColumnRenamed("instrument_id", "anchor"))


@plan("identity_sources", "SELECT a.instrument_id, a.ticker, a.start_date, a.end_date, min(e.identifier) AS identifier FROM aliases a JOIN evidence e ON e.instrument_id = a.instrument_id AND lower(e.name) = lower(a.ticker) AND e.start_date = a.start_date AND e.end_date = a.end_date GROUP BY 1, 2, 3, 4 HAVING count(*) = 1")
def _(t):
    return identity.identity_sources(t.aliases, t.evidence)


@plan("episode_gaps", "SELECT * FROM gaps")
def _(t):
    return t.gaps


@plan("episode_zero_bridge", f"""SELECT instrument_id, first_date, last_date, n_bars, next_traded FROM (SELECT r.instrument_id, r.run, min(r.date) AS first_date, max(r.date) AS last_date, CAST(count(*) AS BIGINT) AS n_bars, min(n.date) AS next_traded FROM (
    SELECT *, sum(CASE WHEN volume <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM long) r
    LEFT JOIN LATERAL (SELECT min(b.date) AS date FROM long b WHERE b.instrument_id = r.instrument_id AND b.date > r.date AND b.volume > 0) n ON true WHERE r.volume = 0 GROUP BY 1, 2) WHERE n_bars >= {S.BRIDGE}""")  # fmt: skip
def _(t):
    return identity.zero_bridges(t.long, S.BRIDGE)


@plan("episode_assign", f"""SELECT instrument_id, episode, min(date) AS first_date, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n_bars, CASE WHEN count(*) < {S.FEWEST} THEN 'quarantined' ELSE 'kept' END AS disposition FROM (
    SELECT b.instrument_id, b.date, CAST(count(g.next_date) OVER (PARTITION BY b.instrument_id ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM long b LEFT JOIN gaps g ON g.instrument_id = b.instrument_id AND g.next_date = b.date) GROUP BY 1, 2""")  # fmt: skip
def _(t):
    return identity.assign_episodes(t.long, t.gaps, S.FEWEST)


HOLE, ZEROES, LEAST = 12, 3, 60
SOURCES = "SELECT instrument_id, 'T' || instrument_id AS ticker, min(date) - 10 AS start_date, max(date) + 10 AS end_date FROM long WHERE instrument_id NOT LIKE '%7' GROUP BY 1"
_VALID = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND high >= greatest(open, low, close) AND low <= least(open, high, close)"
EPISODES = f"""WITH src AS ({SOURCES}),
  b AS (SELECT d.*, s.session_index AS i, NOT ({_VALID}) AS invalid FROM dirty_once d LEFT JOIN long_sessions s ON s.session_date = d.date WHERE instrument_id IN (SELECT instrument_id FROM src)),
  cal AS (SELECT *, sum(CASE WHEN volume = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g, i - lag(i) OVER (PARTITION BY instrument_id ORDER BY date) - 1 AS hole FROM b WHERE i IS NOT NULL),
  runs AS (SELECT instrument_id, g, min(date) AS a, max(date) AS z FROM cal WHERE volume = 0 AND g > 0 GROUP BY 1, 2 HAVING count(*) >= {ZEROES}),
  bridges AS (SELECT r.instrument_id, r.a, r.z, min(c.date) AS split FROM runs r JOIN cal c ON c.instrument_id = r.instrument_id AND c.date > r.z AND c.volume <> 0 GROUP BY 1, 2, 3),
  cuts AS (SELECT instrument_id, date AS split FROM cal WHERE hole >= {HOLE} UNION SELECT instrument_id, split FROM bridges),
  counted AS (SELECT b.*, (SELECT count(*) FROM cuts c WHERE c.instrument_id = b.instrument_id AND c.split <= b.date) AS part,
    EXISTS (SELECT 1 FROM bridges r WHERE r.instrument_id = b.instrument_id AND b.date BETWEEN r.a AND r.z AND b.i IS NOT NULL) AS bridged FROM b),
  parts AS (SELECT instrument_id, part, count(*) AS n, min(date) AS first, max(date) AS last FROM counted WHERE NOT invalid AND NOT bridged GROUP BY 1, 2),
  short AS (SELECT instrument_id, part FROM parts WHERE n < {LEAST} AND instrument_id IN (SELECT instrument_id FROM cuts)),
  large AS (SELECT p.*, row_number() OVER (PARTITION BY instrument_id ORDER BY part) AS ordinal, count(*) OVER (PARTITION BY instrument_id) AS episodes FROM parts p WHERE n >= {LEAST} AND instrument_id IN (SELECT instrument_id FROM cuts))"""


def _assigned(t):
    sources = t.long.filter("instrument_id NOT LIKE '%7'").groupBy("instrument_id").agg(F.date_sub(F.min("date"), 10).alias("start_date"), F.date_add(F.max("date"), 10).alias("end_date"))
    sources = sources.withColumn("ticker", F.concat(F.lit("T"), "instrument_id"))
    return episodes.assigned(t.dirty.distinct(), sources, t.indexed, HOLE, LEAST, ZEROES, t.partitions)


_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('market-data-eod-episode-v1|' || instrument_id || '|' || ticker || '|' || start_date || '|' || ordinal))"


@plan("episode_plan", EPISODES + f"""
  SELECT instrument_id AS source_id, CAST(ordinal AS BIGINT) AS ordinal, substr(u, 1, 12) || '5' || substr(u, 14, 3) || translate(substr(u, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(u, 18, 15) AS instrument_id,
    ticker || '@' || strftime(start_date, '%Y%m%d') AS display_label, start_date, end_date, first AS observed_first, last AS observed_last, CAST(n AS BIGINT) AS n_bars, ticker
  FROM (SELECT *, {_UUID} AS u FROM (SELECT l.*, s.ticker, CASE WHEN ordinal = 1 THEN s.start_date ELSE l.first END AS start_date, CASE WHEN ordinal = episodes THEN s.end_date ELSE l.last END AS end_date
    FROM large l JOIN src s USING (instrument_id) WHERE episodes > 1))""")  # fmt: skip
def _(t):
    """The instruments that take the place of those whose history is several listings."""
    return episodes.plan(_assigned(t))


@plan("episode_quarantine", EPISODES + f"""
  SELECT instrument_id, date, open, high, low, close, volume, CASE WHEN invalid THEN 'ohlc_invariants' WHEN bridged THEN 'zero_volume_episode_bridge' ELSE 'short_inferred_episode' END AS quarantine_reason
  FROM counted c WHERE invalid OR bridged OR EXISTS (SELECT 1 FROM short s WHERE s.instrument_id = c.instrument_id AND s.part = c.part)""")  # fmt: skip
def _(t):
    """Bars that a repair sets aside, with the reason."""
    return episodes.quarantined(_assigned(t), ["instrument_id", "date", "open", "high", "low", "close", "volume"])
