"""Rolling window features: counts, sums, distinct values and quantiles of the events before each event.

Rows become events of a source at a time in whole seconds. Equal events (source, time, length, language)
are counted first, so that copies cost one row. Each source is then split into chunks of time; an event
goes to its own chunk and, as halo, to every later chunk whose windows reach back to it. A chunk with its
halo answers its own times alone: no group holds more than the distinct events of the longest window and
one chunk, however long a source's history is.

Within a chunk, windows of length W lie over blocks of time of length W, and every window over two of
them. The values of both blocks are sorted once and stand in two linked lists, one for each block.
The older block's events leave its list as the window moves on; the newer block's leave it backwards
before the start and come back in order, each by one undone removal. A pointer for each quantile marks
its rank in both lists and moves by as many places as the rank does. Counts and sums are differences of
running sums; a language is counted in a window where its last event before the window's end lies.

Results are one row for each distinct (source, time) and window, joined to the rows of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = (3_600, 21_600)
CHUNKS_PER_WINDOW = 3  # chunks in the longest window: a row is copied once for each, and once for its own
QUANTILES = ((1, 2), (3, 4))  # ranks are ceil(m * a / b), counted from 1
RESULT = "source string, event_s long, window_s long, n_events long, sum_chars long, n_langs long, median_chars long, high_chars long"


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id) mod 4000) / 6), the checksum over the decimal digits."""
    minutes = doc_id + F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4000))
    return F.lit(10) * (minutes - F.pmod(minutes, F.lit(6)))  # whole sixths of 60, without a division


def _ranks(times: np.ndarray, value: np.ndarray, weight: np.ndarray, asked: np.ndarray, window: int, totals: np.ndarray) -> list[list[int | None]]:
    """For each asked time the values at the wanted ranks; all arrays in the order of time, values present."""
    out: list[list[int | None]] = [[None] * len(asked) for _ in QUANTILES]
    for own in np.unique(asked // window):
        queries = np.flatnonzero(asked // window == own)
        old = slice(*np.searchsorted(times, [max(asked[queries[0]] - window, (own - 1) * window), own * window]))
        new = slice(old.stop, int(np.searchsorted(times, asked[queries[-1]])))
        n_old, n = old.stop - old.start, new.stop - old.start
        if n <= 0:
            continue
        span = slice(old.start, new.stop)
        # Place of each event in the order of values, ties in the order of time; the lists link places.
        order = np.argsort(value[span], kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        place, mass, sizes, at = place.tolist(), weight[span][order].tolist(), value[span][order].tolist(), times[span].tolist()
        # Two lists over places 0..n-1; their ends are n and n + 1, their heads -1 and -2.
        after, before = [0] * (n + 4), [0] * (n + 4)
        for head, tail, members in ((-1, n, order[order < n_old]), (-2, n + 1, order[order >= n_old])):
            chain = [head, *np.sort(np.asarray(place)[members]).tolist(), tail]
            for x, y in zip(chain[:-1], chain[1:], strict=True):
                after[x], before[y] = y, x
        for i in range(n - 1, n_old - 1, -1):  # the newer block's events go, the last first
            x = place[i]
            after[before[x]], before[after[x]] = after[x], before[x]
        marks = [[after[-1], n + 1, 0] for _ in QUANTILES]  # in the older list, in the newer one, weight before both
        gone, come = 0, n_old
        for q in queries.tolist():
            t = int(asked[q])
            while gone < n_old and at[gone] < t - window:
                x = place[gone]
                for mark in marks:
                    if x < mark[0]:
                        mark[2] -= mass[x]
                    elif x == mark[0]:
                        mark[0] = after[x]
                after[before[x]], before[after[x]] = after[x], before[x]
                gone += 1
            while come < n and at[come] < t:
                x = place[come]
                after[before[x]] = before[after[x]] = x
                for mark in marks:
                    if x < mark[0] and x < mark[1]:
                        mark[2] += mass[x]
                    elif x < mark[1]:
                        mark[1] = x
                come += 1
            m = int(totals[q])
            if not m:
                continue
            for mark, (a, b), answers in zip(marks, QUANTILES, out, strict=True):
                rank, (u, v, less) = -(-m * a // b), mark
                while less >= rank:
                    if before[u] > before[v]:
                        u = before[u]
                        less -= mass[u]
                    else:
                        v = before[v]
                        less -= mass[v]
                while less + mass[min(u, v)] < rank:
                    if u < v:
                        less += mass[u]
                        u = after[u]
                    else:
                        less += mass[v]
                        v = after[v]
                mark[:] = u, v, less
                answers[q] = sizes[min(u, v)]
    return out


def _distinct(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Number of distinct codes (-1: none) in each window [lo, hi) of an array; both bounds never fall."""
    at = np.flatnonzero(code >= 0)
    at = at[np.argsort(code[at], kind="stable")]
    following = np.full(len(at), len(code), dtype=np.int64)
    same = code[at[1:]] == code[at[:-1]]
    following[:-1][same] = at[1:][same]
    # An event is its code's last one in windows that end after it, but not after the next such event.
    first = np.searchsorted(hi, at, side="right")
    last = np.minimum(np.searchsorted(hi, following, side="right"), np.searchsorted(lo, at, side="right"))
    held = last > first
    steps = np.bincount(first[held], minlength=len(hi) + 1) - np.bincount(last[held], minlength=len(hi) + 1)
    return np.cumsum(steps)[: len(hi)]


def chunk_features(events: pa.Table, chunk: int, chunk_s: int, windows: tuple[int, ...]) -> pa.Table:
    """Figures of the times of the chunk that begins at ``chunk``, from its events and its halo; see ``features``."""
    events = events.sort_by("event_s")
    times, n = events.column("event_s").to_numpy(), events.column("n").to_numpy()
    chars = events.column("chars")
    known = chars.is_valid().to_numpy()
    size = chars.fill_null(0).to_numpy()
    code = events.column("lang").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    asked = np.unique(times[(times >= chunk) & (times < chunk + chunk_s)])
    if not len(asked):
        return pa.table([pa.array([], f.type) for f in _schema(events)], schema=_schema(events))
    running = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    count, total, lengths = running(n), running(n * size), running(np.where(known, n, 0))
    hi = np.searchsorted(times, asked)
    parts = []
    for window in windows:
        lo = np.searchsorted(times, asked - window)
        m = lengths[hi] - lengths[lo]
        ranks = _ranks(times[known], size[known], n[known], asked, window, m)
        columns = [np.full(len(asked), window), count[hi] - count[lo], total[hi] - total[lo], _distinct(code, lo, hi), *ranks]
        source = pa.array([events.column("source")[0].as_py()] * len(asked), pa.string())
        parts.append(pa.table([source, pa.array(asked, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], schema=_schema(events)))
    return pa.concat_tables(parts)


def _schema(events: pa.Table) -> pa.Schema:
    return pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in RESULT.split(", "))])


def window_figures(events: DataFrame, windows: tuple[int, ...] = WINDOWS, chunk_s: int | None = None) -> DataFrame:
    """Figures of (source, event_s, chars, lang) events for each distinct (source, event_s) and window."""
    longest = max(windows)
    chunk_s = chunk_s or max(1, longest // CHUNKS_PER_WINDOW)
    chunk = lambda t: t - F.pmod(t, F.lit(chunk_s))  # noqa: E731  the time at which it begins
    timed = events.filter("event_s IS NOT NULL").groupBy("source", "event_s", "chars", "lang").agg(F.count("*").alias("n"))
    dealt = timed.withColumn("chunk", F.explode(F.sequence(chunk(F.col("event_s")), chunk(F.col("event_s") + longest), F.lit(chunk_s).cast("long"))))

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return chunk_features(table, key[1].as_py(), chunk_s, windows)

    return dealt.groupBy("source", "chunk").applyInArrow(answer, RESULT)


def features(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, chunk_s: int | None = None) -> DataFrame:
    """Two rows for each row of ``docs`` (doc_id, text, lang, source): the figures of both windows before its time.

    A window of ``window_s`` seconds holds all rows of the source whose time is in [event_s - window_s, event_s).
    ``n_events`` counts them, ``sum_chars`` adds their texts' code points, ``n_langs`` counts distinct languages;
    ``median_chars`` and ``high_chars`` are the lengths at ranks ceil(m / 2) and ceil(75 m / 100) of its m texts.

    Null text: no length, but counted as an event; empty text: length 0. Null source: one source of its own.
    Null language: not counted. Null doc_id: no time; such a row is in no window and its own are empty.
    Repeated rows count as often as they stand and each get their rows. Rows of one time don't see each other.
    An empty table gives no rows; further columns are not read.
    """
    rows = docs.select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"), event_time(F.col("doc_id")).alias("event_s"))
    figures = window_figures(rows.select("source", "event_s", "chars", "lang"), windows, chunk_s)
    figures = figures.select(F.col("source").alias("f_source"), F.col("event_s").alias("f_event_s"), "window_s", *FIGURES)
    timed = rows.select("doc_id", "source", "event_s").filter("event_s IS NOT NULL")
    found = timed.join(figures, timed.source.eqNullSafe(figures.f_source) & (timed.event_s == figures.f_event_s))
    untimed = rows.filter("event_s IS NULL").select("doc_id", "event_s", F.explode(F.array([F.lit(w).cast("long") for w in windows])).alias("window_s"))
    for name in FIGURES:
        untimed = untimed.withColumn(name, F.lit(None if name.endswith("_chars") and name != "sum_chars" else 0).cast("long"))
    columns = ["doc_id", "window_s", "event_s", *FIGURES]
    return found.select(columns).unionByName(untimed.select(columns))


FIGURES = ["n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]

#: The checksum bit by bit over the digits; windows by SQL's own frames.
ORACLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS chars,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, d: list_reduce(list_prepend(xor(c, d), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, b: xor(a >> 1, (a & 1) * 3988292384::BIGINT)))) AS h
  FROM documents
), timed AS (SELECT *, CAST(60 * floor((doc_id + h % 4000) / 6.0) AS BIGINT) AS event_s FROM hashed)
""" + " UNION ALL ".join(
    f"""
SELECT doc_id, CAST({w} AS BIGINT) AS window_s, event_s, CASE WHEN doc_id IS NULL THEN 0 ELSE count(*) OVER w END AS n_events,
  CAST(CASE WHEN doc_id IS NULL THEN 0 ELSE coalesce(sum(chars) OVER w, 0) END AS BIGINT) AS sum_chars,
  CASE WHEN doc_id IS NULL THEN 0 ELSE count(DISTINCT lang) OVER w END AS n_langs,
  CASE WHEN doc_id IS NOT NULL THEN quantile_disc(chars, 0.5) OVER w END AS median_chars,
  CASE WHEN doc_id IS NOT NULL THEN quantile_disc(chars, 0.75) OVER w END AS high_chars
FROM timed WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"""
    for w in WINDOWS
)
