"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on trusted text: all documents whose label says quality 1, but for the half by a
hash of their ids that is held out for the thresholds. Trigrams are dealt to shards by their middle
word, so that a context, its bigrams and all their sums stand in one shard; words with too many
trigrams for one are split by the word before. All rows that move are packed: the distinct trigrams of
a run of texts for one shard, as numbers of the words they name, and their counts.

Documents form blocks. A block knows the most frequent words, and Bloom filters of the counted bigrams
and of the other words: 32 MB together at most for bigrams, 32 for words, whatever the table's size; where
they can't tell much there are none, and blocks ask for all. What no count bears on is scored in the
block; all else is asked of the shard of its middle word, which returns each document's sum. Words whose
own share a shard does not know are joined with the table of words last. Sums are of whole numbers, so
that no order and no filter changes a score. Texts ask in up to four passes, so that only a part of the
questions is on disk at a time. Shards are as many as the texts and the table need.

Thresholds are quantiles of the held-out trusted documents' scores, by language, over all of them.
A document's score is its mean negative log-probability, drawn toward its language's trusted mean
by ``prior_words`` words, so that a few odd words don't condemn a short text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm import textops
from barlake.llm.blocks import expand, squeeze
from barlake.llm.storage import discard, durable, shards

MOST = 2**31 - 1  # stands for a bound that is not given
LONG_SHARE = 20  # documents above a twentieth of the characters come last
QUANTILE = 0.995
PRIOR_WORDS = 20
MIN_TRUSTED = 50
BINS_PER_NAT = 200
START = np.uint64(1)  # stands for the two places before a text
KEY_BITS = 48
SHARD_BITS = 4  # at least
FILTER_BITS = 1 << 28  # of all shards' filters together
RUN_WORDS = 1_000_000  # of texts that are counted together
BLOCK_WORDS = 500_000  # and that ask together
BLOCKS_PER_TASK = 8
PASSES = 4  # in which large tables ask, so that a part of the questions is on disk at a time
PASS_CHARS = 50_000_000  # at least
FREQUENT = 1 << 19  # words that blocks know by a number
GROUP_CHARS = 500_000_000  # of text that 16 shards answer, and so many n-grams that they hold:
GROUP_GRAMS = 32_000_000
PAIR, WORD, TWICE, THRICE = range(4)  # kinds of counts
ASKED, BASE, LEFT = range(3)  # kinds of rows between blocks and shards
MODEL = "shard long, n long, n_words long, words binary, v binary, u binary, w binary, c binary"
ASKED_ROWS = "shard long, block long, kind int, n long, rows long, n_words long, words binary, counts binary, u binary, v binary, w binary"
ANSWERS = "block long, kind int, n long, counts binary, v binary, w binary"


def _arrow(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in columns.split(", "))])


MODEL_ARROW, ASKED_ARROW, ANSWER_ARROW = map(_arrow, (MODEL, ASKED_ROWS, ANSWERS))


def discounts(ones: float, twos: float, threes: float, fours: float) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4.

    Each lies within [0.05, its count less 0.05]; where no n-gram has a count its neighbour's share stands in.
    """
    y = ones / (ones + 2 * twos) if ones else 0.5
    raw = [1 - 2 * y * twos / ones if ones else y, 2 - 3 * y * threes / twos if twos else 2 * y, 3 - 4 * y * fours / threes if threes else 3 * y]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def trained() -> Column:
    """Whether a trusted document may train: the half with a hash from 0 up; the others are held out, in any table."""
    return F.xxhash64("doc_id") >= 0


def trusted_text(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The whole texts of all documents with one of the given ids that may train."""
    return docs.filter(trained() & (F.length("text") > 0)).join(trusted.filter(trained()), "doc_id", "left_semi")


def trusted_sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """Trusted documents in the order of a hash of their id, within both bounds; whole texts.

    For callers that want a bounded model; the registered queries train on ``trusted_text``. Only the half with a hash from 0 up may train, so that any table leaves documents held out.
    Documents above a share of ``max_chars`` come after all others, the shortest first, so that none
    keeps others out. If there are none but longer than ``max_chars``, the shortest trains with its
    first ``max_chars`` characters.
    """
    place = [F.greatest("n", F.lit(max_chars // LONG_SHARE)), F.col("h"), F.col("doc_id")]
    # Lengths, and no texts, are joined with the labels.
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n")).filter("n > 0 AND h >= 0")
    texts = texts.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    sized = texts.groupBy("doc_id", "h").agg(F.sum("n").alias("n")).orderBy(*place).limit(max_docs)
    running = F.sum(F.least("n", F.lit(max_chars))).over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    chosen = sized.withColumn("total", running).filter(F.col("total") <= max_chars).select("doc_id")
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most max_docs ids
    return durable(sample.withColumn("text", F.substring("text", 1, max_chars)), "trusted", tidy=True)


def _key(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The key of an n-gram from its words' hashes; a longer one's builds on the shorter one's."""
    with np.errstate(over="ignore"):
        h = textops.mix(first ^ np.uint64(0x5851F42D4C957F2D))
        for x in more:
            h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def _history(words: textops.Words, ids: np.ndarray, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word with the two before it in its row."""
    place = np.arange(len(ids)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    u, v = np.full_like(ids, start), np.full_like(ids, start)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    v[place < 1], u[place < 2] = start, start
    return u, v, ids


def _find(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value among the sorted ones, or -1."""
    if not len(held):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return np.where(held[at] == wanted, at, -1)


def _home(v: np.ndarray, bits: int) -> np.ndarray:
    return (textops.mix(v) >> np.uint64(64 - bits)).astype(np.int64)


class _Deal:
    """The shard of a trigram: that of its middle word, so that its context, its bigram and their sums meet.

    Words with more trigrams than a shard should hold are split by the word before them; then their
    contexts still stand whole in one shard, and their bigrams are summed over the shards.
    """

    def __init__(self, bits: int, parts: dict[int, int]):
        self.bits = bits
        self.words = np.array(sorted(x & (1 << 64) - 1 for x in parts), dtype=np.uint64)
        self.parts = np.array([parts[int(x)] for x in self.words.view(np.int64)], dtype=np.int64)

    def split(self, v: np.ndarray) -> np.ndarray:
        return _find(self.words, v) >= 0

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, at = _home(v, self.bits), _find(self.words, v)
        hot = np.flatnonzero(at >= 0)
        if len(hot):
            step = (textops.mix(u[hot]) % self.parts[at[hot]].astype(np.uint64)).astype(np.int64)
            out[hot] = (out[hot] + step) % (1 << self.bits)
        return out

    def shards(self) -> list[tuple[int, int]]:
        """(word, shard) of the words that are split."""
        home = _home(self.words, self.bits).tolist()
        return [(int(w), (h + i) % (1 << self.bits)) for w, h, k in zip(self.words.view(np.int64), home, self.parts.tolist(), strict=True) for i in range(k)]


def _runs(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[tuple[pa.RecordBatch, textops.Words]]]:
    """Slices of whole rows with their words, in runs of about so many."""
    held, size = [], 0
    for batch in batches:
        for words in textops.split_words(batch.column(column)):
            held.append((batch.slice(words.first, words.rows), words))
            size += len(words.starts)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _trigrams(run: list[tuple[pa.RecordBatch, textops.Words]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_history(words, textops.word_hashes(words), START) for _, words in run), strict=True)]


def _counts(u: np.ndarray, v: np.ndarray, w: np.ndarray, size: int, c: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct trigrams of word numbers below ``size`` in the order of v, u, w, with their counts."""
    context, at = np.unique(v * size + u, return_inverse=True)
    if c is None:
        gram, n = np.unique(at * size + w, return_counts=True)
    else:
        gram, at = np.unique(at * size + w, return_inverse=True)
        n = np.zeros(len(gram), dtype=np.int64)
        np.add.at(n, at, c)
    pair = context[gram // size]
    return pair % size, pair // size, gram % size, n


def _row(shard: int, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> dict:
    blobs = {k: squeeze(x.astype("<u4")) for k, x in (("u", u), ("w", w), ("c", c))}
    return {"shard": shard, "n": len(v), "n_words": len(words), "words": squeeze(np.diff(words, prepend=np.uint64(0))), "v": squeeze(np.diff(v, prepend=0).astype("<u4")), **blobs}


def _opened(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted words, [u, v, w, c] of all rows' n-grams as numbers of these words and counts)."""
    own = [np.cumsum(expand(r["words"], r["n_words"], "<u8"), dtype=np.uint64) for r in rows]
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    for r, mine in zip(rows, own, strict=True):
        at = np.searchsorted(words, mine)
        parts = {k: expand(r[k], r["n"], "<u4").astype(np.int64) for k in "uvwc"}
        for i, x in enumerate((at[parts["u"]], at[np.cumsum(parts["v"])], at[parts["w"]], parts["c"])):
            out[i].append(x)
    return words, [np.concatenate(x) for x in out]


def _counted(deal):
    """Each run of texts: the trigrams of one shard and their counts, in a packed row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, 0, RUN_WORDS):
            u, v, w = _trigrams(held)
            shard = deal.value.shard(u, v)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange((1 << deal.value.bits) + 1))
            rows = []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b > a:
                    words, at = np.unique(np.concatenate([x[order[a:b]] for x in (u, v, w)]), return_inverse=True)
                    rows.append(_row(i, words, *_counts(*at.reshape(3, -1), len(words))))
            yield pa.RecordBatch.from_pylist(rows, MODEL_ARROW)

    return run


def _merged(table: pa.Table) -> pa.Table:
    words, (u, v, w, c) = _opened(table.to_pylist())
    return pa.Table.from_pylist([_row(table.column("shard")[0].as_py(), words, *_counts(u, v, w, len(words), c))], MODEL_ARROW)


def _pairs_of(row: dict, deal: _Deal) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, v, w, number of distinct words before v w, whether v is split) of a shard's bigrams."""
    words, (_, v, w, _) = _opened([row])
    pair, n = np.unique(v * len(words) + w, return_counts=True)
    v, w = pair // len(words), pair % len(words)
    return words, v, w, n, deal.split(words)[v]


def _followed(deal):
    """(v, w, n) of the split words' bigrams; (null, w, number of words before it) and (null, null, number of bigrams with n) of all others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, v, w, n, split = _pairs_of(row, deal.value)
                before = np.bincount(w[~split], minlength=len(words))
                some = np.flatnonzero(before)
                grams, times = np.unique(n[~split], return_counts=True)
                grams3, times3 = np.unique(expand(row["c"], row["n"], "<u4"), return_counts=True)
                for kind, a, b, c in (
                    (PAIR, words[v[split]].view(np.int64), words[w[split]].view(np.int64), n[split]),
                    (WORD, np.zeros(len(some), np.int64), words[some].view(np.int64), before[some]),
                    (TWICE, np.zeros(len(grams), np.int64), grams, times),
                    (THRICE, np.zeros(len(grams3), np.int64), grams3, times3),
                ):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (a, b, c))], names=["kind", "v", "w", "n"])

    return run


def _packed_pairs(table: pa.Table) -> pa.Table:
    """Bigrams of split words in the form of trigrams without their first word."""
    v, w = (table.column(c).to_numpy().view(np.uint64) for c in "vw")
    words, at = np.unique(np.concatenate([v, w]), return_inverse=True)
    v, w = at.reshape(2, -1)
    order = np.lexsort((w, v))
    row = _row(table.column("shard")[0].as_py(), words, np.zeros(len(v)), v[order], w[order], table.column("n").to_numpy()[order])
    return pa.Table.from_pylist([row], MODEL_ARROW)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times) of words that are a five hundredth of a run's words, as the middle of trigrams."""
    for held in _runs(batches, 0, RUN_WORDS):
        word, n = np.unique(_trigrams(held)[1], return_counts=True)
        some = n * 500 >= n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(word[some].view(np.int64)), pa.array(n[some])], names=["v", "n"])


@dataclass
class CountTable:
    """The model: trigrams and their counts in shards, and how many words stand before each word."""

    trigrams: DataFrame
    words: DataFrame
    pairs: DataFrame | None  # of words that are split, with their shard
    deal: _Deal
    less: list[list[float]]  # what is taken off counts 0 to 3 of words, bigrams, trigrams
    distinct: int  # words
    total: int  # distinct bigrams
    chars: int  # of the texts that will be scored
    unknown: float

    def parts(self) -> DataFrame:
        """(pairs, packed rows) of each shard."""
        own = self.trigrams.withColumn("pairs", F.lit(False))
        if self.pairs is None:
            return own
        hot = self.pairs.groupBy("shard").applyInArrow(_packed_pairs, MODEL)
        return own.unionByName(hot.withColumn("pairs", F.lit(True)))

    def share(self, n: Column) -> Column:
        """A word's discounted share from how many words stand before it."""
        return F.coalesce((n - F.element_at(F.array(*map(F.lit, self.less[0])), (F.least(n, F.lit(3)) + 1).cast("int"))) / float(self.total), F.lit(0.0))

    def shares(self) -> DataFrame:
        """(key, a, b) of all n-grams: the share in its context, and the mass it leaves to shorter ones as a context."""
        less, deal = self.less, self.deal

        def run(table: pa.Table) -> pa.Table:
            x = _Shard(table, less, deal)
            word = lambda i: x.words[i.astype(np.int64)]
            n = len(x.words)
            u, v = x.contexts % n, x.contexts // n
            rows = [(_key(word(u[x.grams // n]), word(v[x.grams // n]), word(x.grams % n)), x.gram_share, None), (_key(word(u), word(v)), None, x.context_mass)]
            rows += [(_key(word(x.bigrams // n), word(x.bigrams % n)), x.bigram_share, None), (_key(x.words[x.leads]), None, x.word_mass[x.leads])]
            return pa.concat_tables(pa.table({"key": (k >> np.uint64(64 - KEY_BITS)).view(np.int64), **{c: pa.nulls(len(k), pa.float64()) if y is None else pa.array(y) for c, y in (("a", a), ("b", b))}}) for k, a, b in rows)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = _key(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1), pa.nulls(len(batch), pa.float64())], names=["key", "a", "b"])

        single = self.words.select("w", self.share(F.col("n")).alias("a")).mapInArrow(keyed, "key long, a double, b double")
        every = self.parts().groupBy("shard").applyInArrow(run, "key long, a double, b double").unionByName(single)
        return every.groupBy("key").agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("a"), F.coalesce(F.max("b"), F.lit(1.0)).alias("b"))

    def collect(self) -> list:
        """All rows of ``shares``, for small models."""
        return self.shares().collect()

    def discard(self) -> None:
        discard(self.trigrams, self.words, *([] if self.pairs is None else [self.pairs]))


def count_table(sample: DataFrame, chars: int = 0) -> tuple[CountTable, float] | None:
    """(the counts of n-grams in the texts, share of an unknown word), or None without any word.

    P(w | u v) = a(uvw) + b(uv) * (a(vw) + b(v) * (unknown + a(w))), where ``a`` is an n-gram's discounted
    share in its context and ``b`` the mass that it, as a context, leaves to shorter ones; what was not
    counted has a = 0 and b = 1. ``chars`` is the size of the texts that will be scored.
    """
    spark, text = sample.sparkSession, sample.select("text")
    own = text.agg(F.sum(F.length("text"))).first()[0] or 0
    bits, _ = layout(own // 3, chars)
    each = max(GROUP_GRAMS >> SHARD_BITS, 1)
    parts = {}
    if own // 2 > each:  # else no word can have as many trigrams
        heavy = text.mapInArrow(_heavy, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).filter(F.col("n") > each).collect()
        parts = {r.v: min(-(-r.n // each), 1 << bits) for r in heavy}
    deal = _Deal(bits, parts)
    shared = spark.sparkContext.broadcast(deal)
    counted = text.mapInArrow(_counted(shared), MODEL).repartition(shards(spark, 1 << bits), "shard")
    trigrams = durable(counted.groupBy("shard").applyInArrow(_merged, MODEL), "trigrams", tidy=True)

    found = trigrams.mapInArrow(_followed(shared), "kind int, v long, w long, n long").groupBy("kind", "v", "w").agg(F.sum("n").alias("n"))
    found = durable(found, "followed", tidy=True)
    held = found.filter(F.col("kind") == PAIR) if parts else None
    before = found.filter(F.col("kind") == WORD).select("w", "n")
    if parts:
        before = before.unionByName(held.groupBy("w").agg(F.count("*").alias("n")))
        before = before.groupBy("w").agg(F.sum("n").alias("n"))
    words = durable(before, "words", tidy=True)
    pairs = None
    if parts:
        places = spark.createDataFrame(deal.shards(), "v long, shard long")
        pairs = durable(held.join(F.broadcast(places), "v").select("shard", "v", "w", "n"), "pairs", tidy=True)

    def off(times: dict[int, int]) -> list[float]:
        return [0.0, *discounts(*(float(times.get(i, 0)) for i in (1, 2, 3, 4)))]

    times = {k: {r.w: r.n for r in found.filter((F.col("kind") == k) & (F.col("w") <= 4)).collect()} for k in (TWICE, THRICE)}
    if parts:
        for r in held.filter("n <= 4").groupBy("n").count().collect():
            times[TWICE][r.n] = times[TWICE].get(r.n, 0) + r["count"]
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    if not total:
        discard(trigrams, found, words, *([pairs] if parts else []))
        return None
    ones = dict(words.filter("n <= 4").groupBy("n").count().collect())
    less = [off(ones), off(times[TWICE]), off(times[THRICE])]
    few = {i: ones.get(i, 0) for i in (1, 2)}
    taken = less[0][1] * few[1] + less[0][2] * few[2] + less[0][3] * (distinct - few[1] - few[2])
    discard(found)
    # Known words, the start of texts, and one word for all unknown ones share what is taken off.
    unknown = taken / total / (distinct + 2)
    return CountTable(trigrams, words, pairs, deal, less, distinct, total, chars, unknown), unknown


class _Shard:
    """A shard's part of the model: shares of its n-grams and the masses of its contexts, found by word numbers."""

    def __init__(self, table: pa.Table, less: list[list[float]], deal: _Deal):
        rows = table.to_pylist()
        split = [r for r in rows if r["pairs"]]
        words, (u, v, w, c) = _opened(rows)
        self.words, n = words, max(len(words), 1)
        grams = len(v) - sum(r["n"] for r in split)
        if rows and rows[0]["pairs"]:  # the split words' bigrams come last
            order = np.r_[len(v) - grams : len(v), 0 : len(v) - grams] if len(rows) > 1 else np.arange(len(v))
            u, v, w, c = (x[order] for x in (u, v, w, c))
        more = v[grams:] * n + w[grams:], c[grams:]
        u, v, w, c = (x[:grams] for x in (u, v, w, c))
        two, three = (np.array(x) for x in less[1:])
        self.contexts, at = np.unique(v * n + u, return_inverse=True)
        total, off = np.bincount(at, c), three[np.minimum(c, 3)]
        self.context_mass = np.bincount(at, off) / total
        self.grams, self.gram_share = at * n + w, (c - off) / total[at]  # in order, as trigrams are
        own = v * n + w
        if len(more[0]):
            own = own[~deal.split(words)[v]]
        self.bigrams, times = np.unique(own, return_counts=True)
        if len(more[0]):
            both, times = np.concatenate([self.bigrams, more[0]]), np.concatenate([times, more[1]])
            order = np.argsort(both)
            self.bigrams, times = both[order], times[order]
        lead = self.bigrams // n
        off, total = two[np.minimum(times, 3)], np.bincount(lead, times, minlength=n)
        self.bigram_share = (times - off) / total[lead]
        self.leads = np.flatnonzero(total)
        self.word_mass = np.ones(n + 1)  # the last one is that of words without a number
        self.word_mass[self.leads] = np.bincount(lead, off, minlength=n)[self.leads] / total[self.leads]

    def looked_up(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """a(uvw), b(uv), a(vw), b(v) for word numbers, -1 for words without one."""
        n = max(len(self.words), 1)
        context = np.where((u >= 0) & (v >= 0), _find(self.contexts, v * n + u), -1)
        gram = np.where((context >= 0) & (w >= 0), _find(self.grams, context * n + w), -1)
        pair = np.where((v >= 0) & (w >= 0), _find(self.bigrams, v * n + w), -1)
        pick = lambda x, at, other: np.append(x, other)[at]
        return pick(self.gram_share, gram, 0.0), pick(self.context_mass, context, 1.0), pick(self.bigram_share, pair, 0.0), self.word_mass[v]


def layout(grams: int, chars: int) -> tuple[int, int]:
    """(bits of a hash that name a shard, bits of each shard's filter) for a table and the texts that ask it.

    A shard's part of the table and what it is asked stay within bounds; filters keep one size together, up
    to which they have 64 bits an n-gram, and there are none where less than 3 bits an n-gram are left.
    """
    needed = max(-(-chars // GROUP_CHARS), -(-grams // GROUP_GRAMS), 1)
    shard_bits = SHARD_BITS + (needed - 1).bit_length()
    return shard_bits, filter_size(grams, shard_bits)


def filter_size(grams: int, shard_bits: int, each: int = 64) -> int:
    if 3 * grams > FILTER_BITS:
        return 0
    return max(1024, min(FILTER_BITS, 1 << (each * grams).bit_length()) >> shard_bits)


def _places(key: np.ndarray, size: int) -> list[np.ndarray]:
    """A key's three places in a filter of so many bits, a power of two."""
    h = textops.mix(key)
    return [(x & np.uint64(size - 1)).astype(np.int64) for x in (key, h, h >> np.uint64(32))]


def _filter(key: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, dtype=bool)
    for at in _places(key, size):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class _Filters:
    """The shards' filters in one array, looked up for keys of any shard at once; all keys pass where there are none."""

    def __init__(self, rows: list, size: int):
        self.size, self.bits = size, None
        if size:
            by_shard = {r.shard: bytes(r["filter"]) for r in rows}
            self.place = np.full(max(by_shard, default=0) + 2, -1, dtype=np.int64)
            self.place[list(by_shard)] = np.arange(len(by_shard))
            self.bits = np.frombuffer(b"".join(by_shard.values()) or bytes(1), np.uint8)

    def passed(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(key), dtype=bool)
        first = self.place[np.minimum(shard, len(self.place) - 1)]
        out = first >= 0
        first = np.maximum(first, 0) * self.size
        for x in _places(key, self.size):
            at = np.where(out, first + x, 0)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


class _Known:
    """What blocks of texts know of the model: its most frequent words, and filters of the others and of bigrams.

    A word's number is its place among the frequent ones by their rank, from 1 up; 0 is any word that was not counted.
    Among the words of one shard it has a smaller one, ``within``.
    """

    def __init__(self, table: CountTable, frequent: pa.Table, masses: pa.Table, pairs: _Filters, words: _Filters | None):
        self.deal, self.pairs, self.words, self.unknown = table.deal, pairs, words, table.unknown
        self.ranked = np.append(START, frequent.column("w").to_numpy().view(np.uint64))
        self.order = np.argsort(self.ranked).astype(np.int32)
        self.sorted = self.ranked[self.order]
        n = np.append(0, frequent.column("n").to_numpy()).astype(float)
        share = (n - np.array(table.less[0])[np.minimum(n, 3).astype(int)]) / table.total
        self.chance = table.unknown + np.append(0.0, share)  # of a number
        self.mass = np.full(len(self.chance), np.nan)  # that it leaves to shorter ones, where that is known
        at = _find(self.sorted, masses.column("v").to_numpy().view(np.uint64))
        self.mass[self.order[at[at >= 0]] + 1] = masses.column("b").to_numpy()[at >= 0]
        split = self.deal.split(self.ranked)
        home = np.where(split, -1, _home(self.ranked, self.deal.bits))
        self.numbered = np.argsort(home, kind="stable").astype(np.int32)  # split words, then each shard's, by rank
        self.first = np.searchsorted(home[self.numbered], np.arange((1 << self.deal.bits) + 1))
        self.within = np.zeros(len(self.chance), dtype=np.int32)
        place = np.arange(len(home))
        skipped = np.where(split[self.numbered], 0, self.first[home[self.numbered]] - self.first[0])
        self.within[self.numbered + 1] = place - skipped + 1

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each distinct word, or -1 for those that must be named by their hash."""
        at = _find(self.sorted, words)
        out = np.where(at >= 0, self.order[at] + 1, 0)
        if self.words is not None:
            rare = np.flatnonzero(at < 0)
            out[rare[self.words.passed(_home(words[rare], self.deal.bits), words[rare])]] = -1
        return out

    def of_shard(self, shard: int) -> np.ndarray:
        """The number of each smaller number in a shard."""
        return np.concatenate([[0], self.numbered[: self.first[0]] + 1, self.numbered[self.first[shard] : self.first[shard + 1]] + 1])

    def bigram(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether a bigram may have been counted."""
        return self.pairs.passed(_home(first, self.deal.bits), _key(first, second)) | self.deal.split(first)


def _fixed(nll: np.ndarray) -> np.ndarray:
    """Whole numbers of 2^-32, whose sums do not depend on an order."""
    return np.rint(nll * 2.0**32).astype(np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, which follow one another."""
    ends = np.cumsum(counts)
    running = np.append(0, np.cumsum(values))
    return running[ends] - running[ends - counts]


def _left(row: np.ndarray, word: np.ndarray, ratio: np.ndarray) -> dict:
    """Words whose own share is looked up last: the row, the word, and what is added to this share."""
    return {"n": len(row), "counts": squeeze(row.astype("<u4")), "w": squeeze(word.astype("<u8")), "v": squeeze(ratio.astype("<f8"))}


def _asking(known, turn: int):
    """Of each block what it knows itself, and of each shard the trigrams of which it must be asked."""

    def block(number: int, held: list[tuple[pa.RecordBatch, textops.Words]]) -> Iterator[dict]:
        k = known.value
        grams = _trigrams(held)
        counts = np.concatenate([np.diff(words.bounds) for _, words in held])
        row = np.repeat(np.arange(len(counts)), counts)
        distinct, at = np.unique(np.concatenate([[START], *grams]), return_inverse=True)
        number_of = k.numbers(distinct)
        u, v, w = at[1:].reshape(3, -1)  # places among the distinct words
        nu, nv, nw = number_of[u], number_of[v], number_of[w]
        (hu, hv, hw), asked = grams, nv != 0
        ask_u, ask_w = np.zeros(len(v), bool), np.zeros(len(v), bool)
        some = np.flatnonzero(asked & (nu != 0))
        ask_u[some] = (hv[some] == START) | k.bigram(hu[some], hv[some])
        some = np.flatnonzero(asked & (nw != 0))
        ask_w[some] = k.bigram(hv[some], hw[some])
        alone = np.flatnonzero(~ask_w & (nw >= 0))
        nll = np.zeros(len(v), np.int64)
        nll[alone] = _fixed(-np.log(k.chance[nw[alone]]))
        some = np.flatnonzero(~ask_u & ~ask_w & (nv > 0))
        some = some[~np.isnan(k.mass[nv[some]])]
        nll[some] += _fixed(-np.log(k.mass[nv[some]]))
        asked[some] = False
        frames = pa.Table.from_batches([b for b, _ in held])
        base = pa.table({"doc_id": frames.column(0), "lang": frames.column(2), "n_words": counts, "nll": _sums(nll, counts)}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, base.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as out:
            out.write_table(base)
        here = number & ((1 << k.deal.bits) - 1)
        yield {"shard": here, "block": number, "kind": BASE, "counts": sink.getvalue().to_pybytes()}
        rare = np.flatnonzero(~ask_w & (nw < 0))
        if len(rare):
            yield {"shard": here, "block": number, "kind": LEFT, **_left(row[rare], hw[rare], np.zeros(len(rare)))}

        which = np.flatnonzero(asked)
        shard = k.deal.shard(hu[which], hv[which])
        order = np.argsort(shard, kind="stable")
        which, bounds = which[order], np.searchsorted(shard[order], np.arange((1 << k.deal.bits) + 1))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b == a:
                continue
            own = which[a:b]
            named, blobs = [], {}
            columns = [np.where(ask_u[own], u[own], -1), v[own], np.where(ask_w[own], w[own], -1)]
            for x in columns:
                named.append(x[(x >= 0) & (number_of[x] < 0)])
            named = np.unique(np.concatenate(named))
            held = len(k.ranked)
            for name, x in zip("uvw", columns, strict=True):
                n = np.where(x < 0, 0, number_of[x])
                n = np.where(n < 0, held + 1 + np.searchsorted(named, x), k.within[n] if name == "v" else n)
                blobs[name] = squeeze(n.astype("<u4"))
            per_row = np.bincount(row[own], minlength=len(counts))
            yield {"shard": i, "block": number, "kind": ASKED, "n": b - a, "rows": len(counts), "n_words": len(named), "words": squeeze(np.diff(distinct[named], prepend=np.uint64(0))), "counts": squeeze(per_row.astype("<u4")), **blobs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (turn << 56) + (TaskContext.get().partitionId() << 32)
        for held in _runs(batches, 1, BLOCK_WORDS):
            yield pa.RecordBatch.from_pylist(list(block(number, held)), ASKED_ARROW)
            number += 1

    return run


def _answer(known, less: list[list[float]]):
    """Each row's sum over its words of which the shard was asked, as whole numbers; what blocks know passes by."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        k, out, x = known.value, [], None
        for batch in asked.to_batches(1):
            (q,) = batch.to_pylist()
            if q["kind"] != ASKED:
                out.append({c: q[c] for c in ("block", "kind", "n", "counts", "v", "w")})
                continue
            if x is None:
                x = _Shard(table, less, k.deal)
                place = np.append(-1, _find(x.words, k.ranked))  # of a number
            named = np.cumsum(expand(q["words"], q["n_words"], "<u8"), dtype=np.uint64)
            at = np.concatenate([place, _find(x.words, named)])
            u, v, w = (expand(q[c], q["n"], "<u4") for c in "uvw")
            own = k.of_shard(q["shard"])
            v = np.where(v < len(k.chance), own[np.minimum(v, len(own) - 1)], v)
            counts = expand(q["counts"], q["rows"], "<u4").astype(np.int64)
            gram, context, pair, word = x.looked_up(at[u], at[v], at[w])
            rare = np.flatnonzero(w >= len(k.chance))
            chance = k.chance[np.minimum(w, len(k.chance) - 1)]
            # The three parts are rounded apart where nothing was counted, as they are if a filter says so.
            nll = _fixed(-np.log(context)) + _fixed(-np.log(word))
            nll += np.where(w > 0, _fixed(-np.log(chance)), 0)
            hit = np.flatnonzero((gram > 0) | (pair > 0))
            nll[hit] = _fixed(-np.log(gram[hit] + context[hit] * (pair[hit] + word[hit] * chance[hit])))
            nll[rare] = _fixed(-np.log(context[rare])) + _fixed(-np.log(word[rare]))
            sums = _sums(nll, counts)
            out.append({"block": q["block"], "kind": ASKED, "n": q["rows"], "counts": squeeze(sums)})
            if len(rare):
                row = np.repeat(np.arange(len(counts)), counts)[rare]
                ratio = (gram[rare] / context[rare] + pair[rare]) / word[rare]
                out.append({"block": q["block"], "kind": LEFT, **_left(row, named[w[rare] - len(k.chance)], ratio)})
        return pa.Table.from_pylist(out, ANSWER_ARROW)

    return run


def _scored(answers: pa.Table) -> pa.Table:
    """A block's documents with the sums of all shards; the place of each in its block."""
    rows = answers.to_pylist()
    (base,) = (r for r in rows if r["kind"] == BASE)
    table = pa.ipc.open_stream(base["counts"]).read_all()
    nll = table.column("nll").to_numpy().copy()
    for r in rows:
        if r["kind"] == ASKED:
            nll += expand(r["counts"], r["n"], "<i8")
    more = {"block": np.full(len(nll), base["block"]), "row": np.arange(len(nll))}
    return pa.table({**more, "doc_id": table.column("doc_id"), "lang": table.column("lang"), "n_words": table.column("n_words"), "fixed": nll})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["block"])), pa.array(expand(r["counts"], n, "<u4").astype(np.int64)), pa.array(expand(r["w"], n, "<u8").view(np.int64)), pa.array(expand(r["v"], n, "<f8"))],
                names=["block", "row", "w", "ratio"],
            )


def perplexities(docs: DataFrame, table: CountTable, unknown: float) -> DataFrame:
    """(doc_id, lang, n_words, nll) of each row of (doc_id, text, lang), each of which is read once.

    Texts ask in up to PASSES passes, by a hash of their id; the shards' parts of the model move once a pass.
    """
    spark, deal = docs.sparkSession, table.deal
    size = filter_size(table.total, deal.bits)

    def pair_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, v, w, _, split = _pairs_of(row, deal)
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "filter": _filter(_key(words[v[~split]], words[w[~split]]), size)}])

    def word_filter(own: pa.Table) -> pa.Table:
        key = own.column("w").to_numpy().view(np.uint64)
        return pa.table({"shard": own.column("shard").slice(0, 1), "filter": pa.array([_filter(key, rare_size)], pa.binary())})

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_home(batch.column(0).to_numpy().view(np.uint64), deal.bits)), batch.column(0)], names=["shard", "w"])

    pair_rows = table.trigrams.mapInArrow(pair_filter, "shard long, filter binary").collect() if size else []
    most = durable(table.words.orderBy(F.desc("n"), "w").limit(FREQUENT), "frequent", tidy=True)
    frequent = most.orderBy(F.desc("n"), "w").toArrow()
    less = table.less

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Shard(pa.Table.from_pylist([row | {"pairs": False}]), less, deal)
                own = x.leads[~deal.split(x.words[x.leads])]
                yield pa.RecordBatch.from_arrays([pa.array(x.words[own].view(np.int64)), pa.array(x.word_mass[own])], names=["v", "b"])

    masses = table.trigrams.mapInArrow(mass, "v long, b double").join(F.broadcast(most.select(F.col("w").alias("v"))), "v", "left_semi").toArrow()
    discard(most)
    rare = None
    if table.distinct > FREQUENT:
        rare_size = filter_size(table.distinct, deal.bits, 16)
        rare_rows = table.words.select("w").mapInArrow(homes, "shard long, w long").groupBy("shard").applyInArrow(word_filter, "shard long, filter binary").collect() if rare_size else []
        rare = _Filters(rare_rows, rare_size)
    known = spark.sparkContext.broadcast(_Known(table, frequent, masses, _Filters(pair_rows, size), rare))
    passes, every = min(PASSES, 1 + table.chars // PASS_CHARS), []
    for i in range(passes):
        own = docs.filter(F.pmod(F.hash("doc_id"), F.lit(passes)) == i) if passes > 1 else docs
        asked = own.mapInArrow(_asking(known, i), ASKED_ROWS).repartition(shards(spark, 1 << deal.bits), "shard")
        every.append(durable(asked.groupBy("shard").cogroup(table.parts().groupBy("shard")).applyInArrow(_answer(known, less), ANSWERS), "answers", tidy=True))
    answers = reduce(DataFrame.unionByName, every)
    # Partitions follow the number of blocks, so that no task's share grows with the corpus.
    blocks = answers.filter(F.col("kind") == BASE).count()
    own = answers.filter(F.col("kind") != LEFT).repartition(shards(spark, blocks, BLOCKS_PER_TASK), "block")
    scored = own.groupBy("block").applyInArrow(_scored, "block long, row long, doc_id long, lang string, n_words long, fixed long")
    nll = F.col("fixed")
    if rare is not None:
        left = answers.filter(F.col("kind") == LEFT).select("block", "n", "counts", "w", "v").mapInArrow(_spread, "block long, row long, w long, ratio double")
        left = left.join(table.words, "w", "left").withColumn("fixed", F.round(-F.log(F.col("ratio") + unknown + table.share(F.col("n"))) * 2.0**32).cast("long"))
        scored = scored.join(left.groupBy("block", "row").agg(F.sum("fixed").alias("more")), ["block", "row"], "left")
        nll = nll + F.coalesce("more", F.lit(0))
    return scored.select("doc_id", "lang", "n_words", (nll / 2.0**32).alias("nll"))


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """By language the upper edge of the bin that holds the quantile of the given (lang, score) rows."""
    bins = scores.select("lang", F.floor(F.col("score") * BINS_PER_NAT).alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    running = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    within = bins.withColumn("below", running).withColumn("total", F.sum("n").over(by)).filter(F.col("below") >= F.col("total") * quantile)
    return within.groupBy("lang").agg(((F.min("bin") + 1) / BINS_PER_NAT).alias("threshold"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    prior_words: float = PRIOR_WORDS,
    max_docs: int | None = None,
    max_chars: int | None = None,
    min_trusted: int = MIN_TRUSTED,
    stable: bool = False,
) -> DataFrame:
    """Judge each row: (doc_id, lang, n_words, perplexity, score, threshold, keep).

    ``labels`` is (doc_id, quality); a document with several labels is trusted if any says 1. A
    language with fewer than ``min_trusted`` held-out trusted documents, or null, has the mean and
    threshold of all languages together. All trusted text outside the held-out half trains, unless a
    caller bounds it by ``max_docs`` or ``max_chars``; then what is left out is held out too. Rows without words have no perplexity, the mean as score,
    and stay. Without trusted text nothing is judged and all rows stay. Rows with a null or repeated
    doc_id are judged each. Other columns are not read. ``stable`` says that the frame gives the same
    partitions when read twice, as a table in files does; other frames are written first.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("lang").cast("string"))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    if not stable:
        docs = durable(docs, "texts", tidy=True)
    # Ids in a table of their own have a known size: Spark sends them to the texts, and moves no texts, while they are few.
    trusted = durable(labels.filter("quality = 1").select("doc_id"), "trusted", tidy=True)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    if max_docs is None and max_chars is None:
        text, trusted = trusted_text(docs, trusted), trusted.filter(~trained())
    else:
        text = trusted_sample(docs, labels, max_docs or MOST, max_chars or MOST)
        trusted = trusted.join(text.select("doc_id"), "doc_id", "left_anti")
    model = count_table(text, size)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_words"), none.alias("perplexity"), none.alias("score"), none.alias("threshold"), F.lit(True).alias("keep"))
    scored = durable(perplexities(docs, *model), "perplexities", tidy=True)
    model[0].discard()

    held = scored.filter("n_words > 0").join(trusted, "doc_id", "left_semi")
    # An overall row for each held-out document besides its language's.
    doubled = held.withColumn("lang", F.explode(F.when(F.col("lang").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("lang")))))
    means = doubled.groupBy("lang").agg((F.sum("nll") / F.sum("n_words")).alias("mean"), F.count("*").alias("n_trusted")).filter(F.col("lang").isNull() | (F.col("n_trusted") >= min_trusted))
    means = durable(means.select("lang", "mean"), "means", tidy=True)
    shrunk = (F.col("nll") + prior_words * F.col("mean")) / (F.col("n_words") + prior_words)
    limits = thresholds(doubled.join(means, doubled.lang.eqNullSafe(means.lang)).select(doubled.lang, shrunk.alias("score")), quantile)
    by_lang = durable(means.join(limits, means.lang.eqNullSafe(limits.lang)).select(means.lang.alias("known"), "mean", "threshold"), "thresholds", tidy=True)
    overall = by_lang.filter("known IS NULL").select(F.col("mean").alias("mean_all"), F.col("threshold").alias("threshold_all"))
    rows = overall.take(1)
    mean_all, threshold_all = rows[0] if rows else (None, None)
    judged = scored.join(by_lang.filter("known IS NOT NULL"), scored.lang == F.col("known"), "left")
    judged = judged.withColumn("mean", F.coalesce("mean", F.lit(mean_all).cast("double"))).withColumn("threshold", F.coalesce("threshold", F.lit(threshold_all).cast("double")))
    return judged.withColumn("score", shrunk).select(
        "doc_id",
        "lang",
        "n_words",
        F.when(F.col("n_words") > 0, F.exp(F.col("nll") / F.col("n_words"))).alias("perplexity"),
        "score",
        "threshold",
        F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("keep"),
    )
