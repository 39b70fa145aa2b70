"""Stupid-backoff scores of every document against the n-gram counts of all other documents.

Relations in packed form. Texts form blocks. A block explodes its n-grams of orders 1 to 3, keeps
the distinct ones with their counts, and deals them by hash to shards. A shard adds the blocks'
counts - its part of the count table - and joins the totals back to the rows each block sent, in
their order. The block's texts meet the returned totals, and scores are summed per document. An
n-gram is in one shard, at most once for each block, so a frequent one is no task's burden, and
what is gathered grows with the corpus. N-grams are identified by KEY_BITS bits of a hash: among n
distinct ones about n * n / 2 ** (KEY_BITS + 1) pairs share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import textops
from barlake.llm.blocks import BLOCK_BYTES, chunks, expand, squeeze, text_blocks
from barlake.llm.storage import durable, shards

ORDER = 3
ALPHA = 0.4
KEY_BITS = 60
CHARS_PER_SHARD = 10_000_000
SCORES = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, n_unseen long, log_score double"


class _Grams:
    """A block's distinct n-grams in the order of their hashes, and where each stands in the texts."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all()
        self.ids = table.column(0)
        keys: list[list[np.ndarray]] = [[], [], []]
        rows: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        for chunk_at, chunk in chunks(table.column(1)):
            for words in textops.split_words(chunk):
                h = textops.word_hashes(words)
                for k in range(ORDER):
                    g = textops.gram_hashes(h, k + 1)
                    # Aligned to the n-gram's last word; starts before the row's first word hold 0.
                    own = np.zeros(len(h), dtype=np.uint64)
                    own[k:] = g
                    place = np.arange(len(h)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
                    own[place < k] = 0
                    keys[k].append(own)
                rows.append(chunk_at + words.first + words.row_of_word())
                ends.append(place)
        none = np.zeros(0, np.uint64)
        by_order = [np.concatenate(k) if k else none for k in keys]
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.place = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        flat = np.concatenate(by_order) >> np.uint64(64 - KEY_BITS)
        del keys, by_order
        self.keys, entry, self.times = np.unique(flat, return_inverse=True, return_counts=True)
        self.entry = entry.reshape(ORDER, -1)

    def in_document(self) -> np.ndarray:
        """For each order and position how often its n-gram stands in its own document."""
        out = np.ones(self.entry.shape, dtype=np.int64)
        for k in range(ORDER):
            again = np.flatnonzero(self.times[self.entry[k]] > 1)
            code = self.row[again] * len(self.keys) + self.entry[k][again]
            _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
            out[k][again] = times[inverse]
        return out


def _shard_bounds(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each shard's keys begin; a shard is a range of hashes."""
    return np.searchsorted(keys, np.array([(i << KEY_BITS) // count for i in range(count)], dtype=np.uint64)).tolist() + [len(keys)]


def _exploded(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, BLOCK_BYTES):  # in the same worker
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _Grams(payload.as_py())
                bounds = _shard_bounds(x.keys, count)
                pairs = [(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                times = np.minimum(x.times, 0xFFFFFFFF).astype("<u4")
                # Steps between sorted keys: the first key itself, then differences.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in pairs], pa.int64()),
                        pa.array([number] * len(pairs), pa.int64()),
                        pa.array([b - a for _, a, b in pairs], pa.int64()),
                        pa.array([squeeze(np.diff(x.keys[a:b], prepend=np.uint64(0))) for _, a, b in pairs], pa.binary()),
                        pa.array([squeeze(times[a:b]) for _, a, b in pairs], pa.binary()),
                    ],
                    names=["shard", "block", "n", "keys", "times"],
                )

    return run


def _count_table(table: pa.Table) -> pa.Table:
    """One shard: totals over all other blocks, given back to each block in the order of its keys."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(expand(b, n, "<u8"), dtype=np.uint64) for b, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
    times = np.concatenate([expand(b, n, "<u4") for b, n in zip(table.column("times").to_pylist(), sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.add.reduceat(times[order].astype(np.int64), first)
    total = np.empty(len(keys), dtype="<i8")
    total[order] = np.repeat(sums, np.diff(np.r_[first, len(keys)]))
    total -= times  # mostly 0, which takes no room
    cut = np.r_[0, np.cumsum(sizes)]
    blobs = [squeeze(total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "n": table.column("n"), "totals": pa.array(blobs, pa.binary())})


def _scores(alpha: float):
    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        parts = sorted(zip(totals.column("shard").to_pylist(), totals.column("n").to_pylist(), totals.column("totals").to_pylist(), strict=True))
        for payload in blocks.column("payload").to_pylist():
            x = _Grams(payload)
            total = np.concatenate([expand(b, n, "<i8") for _, n, b in parts]) if parts else np.zeros(0, np.int64)
            if len(total) != len(x.keys):
                raise ValueError("a block's n-grams changed between two readings of the documents")
            out.append(_score_block(x, total + x.times, alpha))
        return pa.concat_tables(out)

    return run


def _score_block(x: _Grams, total: np.ndarray, alpha: float) -> pa.Table:
    """Scores but for the number of words in other documents, which every lowest level divides by."""
    rows = len(x.ids)
    length = np.bincount(x.row, minlength=rows)
    others = total[x.entry] - x.in_document()
    for k in range(1, ORDER):
        others[k][x.place < k] = 0
    uni, bi, tri = others
    # Counts of the contexts: the n-gram that ends one word earlier.
    before_uni, before_bi = np.r_[0, uni[:-1]], np.r_[0, bi[:-1]]
    levels = [tri > 0, bi > 0, uni > 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        log_p = np.select(
            levels,
            [np.log(tri / before_bi), np.log(bi / before_uni), np.log(uni)],
            0.0,
        )
    level = np.select(levels, [3, 2, 1], 0)
    steps = np.minimum(x.place + 1, ORDER) - np.maximum(level, 1)
    log_p = log_p + steps * np.log(alpha)
    count = [np.bincount(x.row[level == k], minlength=rows) for k in (3, 2, 1, 0)]
    score = np.bincount(x.row, weights=log_p, minlength=rows)
    return pa.table([x.ids.cast(pa.int64()), length, *count, score], names=["doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "n_unseen", "log_score"])


def score(docs: DataFrame, alpha: float = ALPHA, stable: bool = False) -> DataFrame:
    """Score each document by the counts of all other documents' n-grams (orders 1 to 3).

    A word scores log(c(uvw) / c(uv)); where its trigram stands in no other document, log(alpha)
    more and the bigram, then again and the unigram's share of the other documents' words; a word
    no other document has counts as 1 / (those words + 1). Returns one row for each input row, with
    the number of words scored at each level and the sum of logarithms.

    Each row is a document of its own, also where a doc_id repeats or is null. Null and empty texts
    have no words and score 0. Other columns are not read. ``stable`` says that the frame gives the
    same partitions when read twice, as a table in files does; other frames are written first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    if not stable:
        docs = durable(docs, "texts")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = shards(spark, size, CHARS_PER_SHARD)
    blocks = docs.mapInArrow(lambda batches: text_blocks(batches, BLOCK_BYTES), "block long, payload binary")
    exploded = docs.mapInArrow(_exploded(count), "shard long, block long, n long, keys binary, times binary")
    # As many partitions as shards, so that no task's share grows with the corpus.
    totals = exploded.repartition(count, "shard").groupBy("shard").applyInArrow(_count_table, "block long, shard long, n long, totals binary")
    dealt = blocks.repartition(count, "block").groupBy("block").cogroup(totals.repartition(count, "block").groupBy("block"))
    scores = durable(dealt.applyInArrow(_scores(alpha), SCORES), "scores")
    words = scores.agg(F.sum("n_words")).first()[0] or 0
    others = F.lit(words) - F.col("n_words")
    lowest = F.when(F.col("n_unigram") > 0, F.col("n_unigram") * F.ln(others)).otherwise(0.0) + F.col("n_unseen") * F.ln(others + 1)
    return scores.withColumn("log_score", F.col("log_score") - lowest)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), g AS (
  SELECT doc_id, i, word AS g1,
         CASE WHEN i >= 1 THEN lag(word) OVER d || ' ' || word END AS g2,
         CASE WHEN i >= 2 THEN lag(word, 2) OVER d || ' ' || lag(word) OVER d || ' ' || word END AS g3
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), d1 AS (SELECT doc_id, g1, count(*) AS n FROM g GROUP BY ALL),
d2 AS (SELECT doc_id, g2, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY ALL),
d3 AS (SELECT doc_id, g3, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
o1 AS (SELECT doc_id, g1, sum(n) OVER (PARTITION BY g1) - n AS c FROM d1),
o2 AS (SELECT doc_id, g2, sum(n) OVER (PARTITION BY g2) - n AS c FROM d2),
o3 AS (SELECT doc_id, g3, sum(n) OVER (PARTITION BY g3) - n AS c FROM d3),
c AS (
  SELECT g.doc_id, g.i, o1.c AS c1, coalesce(o2.c, 0) AS c2, coalesce(o3.c, 0) AS c3,
         lag(o1.c) OVER d AS b1, lag(coalesce(o2.c, 0)) OVER d AS b2,
         (SELECT count(*) FROM g) - count(*) OVER (PARTITION BY g.doc_id) AS others
  FROM g JOIN o1 ON o1.doc_id = g.doc_id AND o1.g1 = g.g1
  LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.g2 = g.g2
  LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.g3 = g.g3
  WINDOW d AS (PARTITION BY g.doc_id ORDER BY g.i)
), s AS (
  SELECT doc_id, i, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level,
         least(i + 1, 3) - greatest(CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END, 1) AS steps,
         CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) WHEN c1 > 0 THEN ln(c1 / others)
              ELSE -ln(others + 1) END AS lp
  FROM c
), t AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (level = 3) AS l3, count(*) FILTER (level = 2) AS l2,
         count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 0) AS l0, sum(lp + steps * ln(0.4)) AS lp
  FROM s GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(l3, 0) AS BIGINT) AS n_trigram,
       CAST(coalesce(l2, 0) AS BIGINT) AS n_bigram, CAST(coalesce(l1, 0) AS BIGINT) AS n_unigram,
       CAST(coalesce(l0, 0) AS BIGINT) AS n_unseen, round(coalesce(lp, 0), 4) AS log_score
FROM documents LEFT JOIN t USING (doc_id)
"""
