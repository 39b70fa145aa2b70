"""Near-duplicate documents: a MinHash inverted join, confirmed on the full shingle sets.

Documents with equal sets of word shingles are one class. A class's signature has one minimum for
each of ``coordinates`` hash functions; it is posted under every (coordinate, value) pair. Two sets
with the wanted similarity agree in at least ``matches`` coordinates, but for a stated chance, so
that, with postings ordered from rare to frequent, the rarest they share is among the first
(coordinates - matches + 1) of both. Only the lists of these prefixes are merged, and a posting that
only one class has is skipped unread. The frequent postings behind the prefix are never read as
lists: they are probed, coordinate by coordinate, for the pairs that meet in a prefix list. Pairs
below the match threshold are dropped, the others confirmed on their full sets.

Frequent lists of near copies are collapsed on representatives first: every class of a list is
compared with the list's two smallest classes, and confirmed with the one of all its lists it
collides with most. What is then linked needs no more comparison, so that a group of copies costs a
few comparisons a member. Classes that reach the match threshold form a family: with their
representatives, and block by block in the lists that hold several families yet. In a family the
classes that are not linked are compared and confirmed block by block, once, whatever the number of
lists they share; its largest linked group is not compared with itself. Where a family has many such
classes, those meet only in the lists of their rarest shingles, which two linked sets cannot both lack.
A task holds some thousand rows, and no pairs leave it but those that connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import textops
from barlake.llm.graph import components
from barlake.llm.storage import discard, durable

SHINGLE = 5
COORDINATES = 48
MISS = 1e-7
BLOCK = 128
ROUNDS = 1
MOST_OPEN = 1_024  # classes of a family, beside its largest linked group, that are compared as they are
UNIT_ROWS = 2_000
PAIRS_AT_ONCE = 100_000
SEED = 11


def least_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The most coordinates that a linked pair shares but for a chance of ``miss``."""
    total = 0.0
    for m in range(coordinates + 1):
        total += comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if total > miss:
            return max(1, m)
    return coordinates


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, keys, bounds): each row's sorted distinct shingle hashes.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text with fewer than
    ``size`` words has its whole sequence as one shingle, one without words an empty set.
    """
    for words in textops.split_words(column, lower=True):
        h = textops.word_hashes(words)
        at = words.windows(size)
        row, key = words.row_of_word()[at], textops.gram_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
        count = np.diff(words.bounds)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            whole = np.empty(len(few), dtype=np.uint64)
            for k in range(1, size):
                own = count[few] == k
                if own.any():
                    whole[own] = textops.gram_hashes(h, k)[words.bounds[:-1][few[own]]]
            row, key = np.r_[row, few], np.r_[key, whole]
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
        row, key = row[new], key[new]
        yield words.first, key, np.searchsorted(row, np.arange(words.rows + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Row by coordinate minima (32 bits) of the nonempty sets given by bounds."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    out = np.empty((len(bounds) - 1, coordinates), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for r in range(coordinates):
            out[:, r] = np.minimum.reduceat(((keys * a[r] + b[r]) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def describe(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """For each row its set's size, 128-bit fingerprint and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, key, bounds in shingle_sets(batch.column(1), size):
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                f = np.zeros((2, len(n)), dtype=np.uint64)
                sig = np.full(len(n), None, dtype=object)
                if len(full):
                    at = bounds[:-1][full]
                    f[0, full] = np.add.reduceat(textops.mix(key), at)
                    f[1, full] = np.bitwise_xor.reduceat(textops.mix(key * np.uint64(0x9E3779B97F4A7C15)), at)
                    for i, s in zip(full.tolist(), signatures(key, np.r_[at, len(key)], coordinates), strict=True):
                        sig[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n), *(pa.array(x.view(np.int64)) for x in f), pa.array(sig, pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def postings(classes: DataFrame) -> DataFrame:
    """(rep, key): each class under each of its coordinate-value pairs, packed in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.stack([np.frombuffer(s, dtype=np.uint32) for s in batch.column(1).to_pylist()]).astype(np.int64)
            key = (np.arange(sig.shape[1], dtype=np.int64) << 32 | sig).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, sig.shape[1])), pa.array(key)], names=["rep", "key"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, key long")


def prefix_lists(classes: DataFrame, matches: int) -> DataFrame:
    """(key, rep): the lists of two classes or more that the classes' prefixes meet in."""
    posted = postings(classes)
    shared = posted.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    own = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("own"))
    # Of all coordinates those only this class has come first; the prefix is what is left of it.
    first = own.filter(F.size("own") >= matches).select("rep", F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1)).alias("p")).select("rep", "p.key")
    first = durable(first.distinct(), "prefixes")
    several = durable(first.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    return durable(first.join(several, "key").select("key", "rep"), "lists")


def _with_sets(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, key, bounds in shingle_sets(batch.column(1), size):
                n = len(bounds) - 1
                blobs = [key[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sigs = [s.tobytes() if len(k) else None for s, k in zip(_signatures_or_empty(key, bounds, coordinates), blobs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds), pa.int32()), pa.array(sigs, pa.binary()), pa.array(blobs, pa.binary())], names=["rep", "n", "sig", "keys"])

    return run


def _signatures_or_empty(key: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, coordinates), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = signatures(key, np.r_[bounds[:-1][full], len(key)], coordinates)
    return out


def _linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class _Forest:
    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.up = self.up.tolist()
        self.parent = list(range(max(self.up, default=-1) + 1))

    def find(self, i: int) -> int:
        i = self.up[i]
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def _close_pairs(table: pa.Table, matches: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, collisions) of the pairs of a unit that reach the match threshold, in runs.

    A unit (task, x, y) with rows of both sides pairs these; one with a single side pairs its rows.
    """
    unit = np.stack([table.column(c).to_numpy() for c in ("task", "x", "y")])
    side, label, size = (table.column(c).to_numpy() for c in ("side", "label", "n"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(table.num_rows, -1)
    order = np.lexsort((side, *unit[::-1]))
    unit, side = unit[:, order], side[order]
    new = np.r_[True, (unit[:, 1:] != unit[:, :-1]).any(axis=0)]
    of = np.cumsum(new) - 1
    start, end = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(of)]
    ones = np.bincount(of, weights=side).astype(np.int64)
    single = (ones == 0) | (ones == end - start)
    place = np.arange(len(of))
    low = np.where(single[of], place + 1, (end - ones)[of])
    count = np.where(single[of] | (side == 0), end[of] - low, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = count[at:to]
        i = np.repeat(place[at:to], own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[at:to], own)
        i, j = order[i], order[j]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (label[i] != label[j]) & (100 * small >= percent * large)
        i, j = i[ok], j[ok]
        collisions = (sig[i] == sig[j]).sum(axis=1)
        ok = collisions >= matches
        yield i[ok], j[ok], collisions[ok]
        at = to


def _best_partner(matches: int, percent: int):
    """For each class of side 0 its partner with the most collisions: (rep, label, hub, hub_label, n)."""

    def run(table: pa.Table) -> pa.Table:
        rep, label = (table.column(c).to_numpy() for c in ("rep", "label"))
        parts = [np.stack([i, j, n]) for i, j, n in _close_pairs(table, matches, percent)]
        i, j, n = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        order = np.lexsort((rep[j], -n, rep[i]))
        i, j, n = i[order], j[order], n[order]
        first = np.r_[True, rep[i][1:] != rep[i][:-1]] if len(i) else np.zeros(0, bool)
        i, j, n = i[first], j[first], n[first]
        return pa.table({"rep": rep[i], "label": label[i], "hub": rep[j], "hub_label": label[j], "n": n.astype(np.int64)})

    return run


def _touching(matches: int, percent: int):
    """Edges (a, b) from each label to the smallest that its classes are connected with by frequent collisions."""

    def run(table: pa.Table) -> pa.Table:
        label = table.column("label").to_numpy()
        own, at = np.unique(label, return_inverse=True)
        forest = _Forest(own)
        for left, right, _ in _close_pairs(table, matches, percent):
            pairs = np.unique(np.sort(np.stack([at[left], at[right]]), axis=0), axis=1)
            for i, j in pairs.T.tolist():
                forest.join(i, j)
        root = np.array([forest.find(i) for i in range(len(own))], dtype=np.int64)
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, root, own)
        apart = least[root] != own
        return pa.table({"a": own[apart], "b": least[root][apart]})

    return run


def _confirmed(matches: int, percent: int):
    """Links (a, b) of pairs that collide often enough, confirmed on their sets; of each group only those that connect."""

    def run(table: pa.Table) -> pa.Table:
        rep, label = (table.column(c).to_numpy() for c in ("rep", "label"))
        sets = [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in table.column("keys").combine_chunks()]
        forest, out = _Forest(label), []
        for left, right, collisions in _close_pairs(table, matches, percent):
            likely = np.argsort(-collisions, kind="stable")
            for i, j in zip(left[likely].tolist(), right[likely].tolist(), strict=True):
                if forest.find(i) != forest.find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if _linked(both, len(sets[i]), len(sets[j]), percent):
                        forest.join(i, j)
                        out.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _run(tasks: DataFrame, sets: DataFrame, compare, schema: str, name: str) -> DataFrame:
    """Run ``compare`` on the units of ``tasks`` with what ``sets`` has of their classes; many small units a group."""
    tasks = durable(tasks, "tasks")
    groups = max(1, -(-tasks.count() // UNIT_ROWS))
    rows = tasks.withColumn("unit", F.pmod(F.xxhash64("task", "x", "y"), F.lit(groups))).join(sets, "rep")
    found = durable(rows.groupBy("unit").applyInArrow(compare, schema), name)
    discard(tasks)
    return found


def _labels(links: DataFrame) -> DataFrame:
    """(rep, label) of linked classes: one label is one group, though a group may have several labels."""
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("label")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("label")))
    near = both.groupBy("rep").agg(F.least("rep", F.min("label")).alias("label"))
    up = near.select(F.col("rep").alias("label"), F.col("label").alias("up"))
    return durable(near.join(up, "label", "left").select("rep", F.coalesce("up", "label").alias("label")), "labels")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """(rep, label, hub, hub_label): the classes of each list with its smallest class of another label.

    That is the list's smallest class for those it is not connected with. Where it is connected with
    all but some, the smallest of these is a second hub.
    """
    hub = F.min(F.struct(F.col("rep").alias("hub"), F.col("label").alias("hub_label")))
    # Tables between the joins by key and what groups by it let a long list be split over tasks.
    first = durable(lists.groupBy("key").agg(hub.alias("h")).select("key", "h.*"), "hubs")
    apart = durable(lists.join(first, "key").filter("label <> hub_label"), "apart")
    second = durable(apart.groupBy("key").agg(hub.alias("h")).select("key", "h.*"), "hubs")
    one = apart.select("rep", "label", "hub", "hub_label")
    two = apart.drop("hub", "hub_label").join(second, "key").filter("label <> hub_label").select("rep", "label", "hub", "hub_label")
    return durable(one.union(two).distinct(), "hub-pairs")


def _stars(pairs: DataFrame, block: int) -> DataFrame:
    """Tasks (task, x, y, side, rep, label): each hub with the classes it is paired with, a block at a time."""
    hubs = pairs.groupBy("hub", "hub_label").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    hubs = durable(hubs, "hub-parts")
    members = pairs.join(hubs.drop("hub_label"), "hub").select(F.col("hub").alias("task"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "rep", "label")
    centres = hubs.select(F.col("hub").alias("task"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("side"), F.col("hub").alias("rep"), F.col("hub_label").alias("label"))
    return members.union(centres)


def _open_lists(lists: DataFrame, block: int) -> DataFrame:
    """Tasks (task, x, y, side, rep, label): pairs of blocks of lists (key, rep, label) of several labels.

    Blocks of the list's most frequent label meet the blocks of the others, and these each other.
    """
    by_label = lists.groupBy("key", "label").agg(F.count("*").alias("n"))
    kinds = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("a"), F.sum("n").alias("n")).filter("n > a")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    kinds = durable(kinds.withColumn("b", F.col("n") - F.col("a")).select("key", "major", blocks("a").alias("a"), blocks("b").alias("b")), "kinds")
    held = lists.join(kinds, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("label") == F.col("major"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    # (x, y) is a block of the major label and one of the others, or, below 0, two of the others.
    return held.selectExpr(
        "key AS task", "rep", "label",
        """explode(if(label = major,
             transform(sequence(0, b - 1), j -> named_struct('x', own, 'y', j, 'side', 0)),
             concat(transform(sequence(0, a - 1), i -> named_struct('x', i, 'y', own, 'side', 1)),
                    transform(sequence(0, b - 1), j -> named_struct('x', -1 - least(own, j), 'y', greatest(own, j), 'side', if(own <= j, 0, 1)))))) AS at""",
    ).select("task", "at.*", "rep", "label")


def links(docs: DataFrame, classes: DataFrame, percent: int, size: int, coordinates: int, miss: float, block: int, rounds: int, most_open: int) -> DataFrame:
    """Edges (a, b) between classes: their components are those of all links."""
    matches = least_matches(coordinates, percent / 100, miss)
    lists = prefix_lists(classes, matches)
    members = docs.join(lists.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    # A doc_id that repeats has several sets: it is one node, compared by each of them.
    sets = durable(members.mapInArrow(_with_sets(size, coordinates), "rep long, n int, sig binary, keys binary").filter("sig IS NOT NULL"), "sets")
    prints, link = sets.select("rep", "n", "sig"), "a long, b long"
    found, near, known = [], [], lists.withColumn("label", F.col("rep"))
    for _ in range(rounds):
        pairs = _hub_pairs(known)
        best = _run(_stars(pairs, block), prints, _best_partner(matches, percent), "rep long, label long, hub long, hub_label long, n long", "best-hubs")
        best = durable(best.groupBy("rep").agg(F.max_by(F.struct("label", "hub", "hub_label"), F.struct("n", "hub")).alias("h")).select("rep", "h.*"), "best-hub")
        near.append(best.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
        found.append(_run(_stars(best, block), sets, _confirmed(matches, percent), link, "links"))
        labels = _labels(_union(found))
        known = lists.join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    # Classes that collide often enough form families, by their representatives first; where a list
    # still has classes of several, they are compared. Each family is then confirmed once.
    by_hub = lists.select("rep").distinct().withColumn("family", F.col("rep"))
    if near:
        by_hub = by_hub.drop("family").join(components(_union(near)).withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("family"))
    by_hub = durable(by_hub, "families")
    touching = _run(_open_lists(lists.join(by_hub.withColumnRenamed("family", "label"), "rep"), block), prints, _touching(matches, percent), link, "touching")
    joined = components(touching).select(F.col("node").alias("family"), F.col("label").alias("whole"))
    family = by_hub.join(joined, "family", "left").select("rep", F.coalesce("whole", "family").alias("key"))
    members = durable(known.select("rep", "label").distinct().join(family, "rep").select("key", "rep", "label"), "members")
    # Families whose open classes are few are confirmed as they are; larger ones by the lists of their
    # rarest shingles, of which two linked sets share one.
    wide = durable(_wide_families(members, most_open), "wide")
    small = members.join(wide, "key", "left_anti")
    found.append(_run(_open_lists(small, block), sets, _confirmed(matches, percent), link, "links"))
    if not wide.isEmpty():
        rare = rare_lists(members.join(wide, "key"), sets, percent)
        found.append(_run(_open_lists(rare, block), sets, _confirmed(matches, percent), link, "links"))
    return _union(found)


def _wide_families(members: DataFrame, most_open: int) -> DataFrame:
    """(key): families with more than ``most_open`` classes outside their largest linked group."""
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    return by_label.groupBy("key").agg(F.max("n").alias("largest"), F.sum("n").alias("n")).filter(F.col("n") - F.col("largest") > most_open).select("key")


def rare_lists(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, label): lists of a family's classes that share a shingle among the rarest of both.

    In a set of n shingles, ordered from rare to frequent within the family, the first n - ceil(percent * n /
    100) + 1 hold one that every linked set has among its own first ones: what is left is too few. Pages of
    one template differ in more shingles than that, which they share with no other, and so meet in no list.
    """
    own = durable(members.join(sets.select("rep", "keys"), "rep").withColumn("set", F.xxhash64("rep", "keys")).mapInArrow(_shingles, "key long, rep long, label long, set long, n int, shingle long"), "shingles")
    # In a table, so that a shingle that a whole family has is split where the join finds it large.
    times = durable(own.groupBy("key", "shingle").agg(F.count("*").alias("times")).filter("times > 1"), "shingle-counts")
    # Shingles that no other class has come first, whatever their order: only their number counts.
    shared = own.join(times, ["key", "shingle"])
    places = shared.groupBy("key", "rep", "label", "set", "n").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    prefix = places.filter(first > 0).select("key", "rep", "label", F.explode(F.slice("shared", F.lit(1), first.cast("int"))).alias("s"))
    return durable(prefix.select(F.xxhash64("key", "s.shingle").alias("key"), "rep", "label").distinct(), "rare-lists")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, some hundred thousand a batch."""
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i].as_py() for c in ("key", "rep", "label", "set")}
            keys = np.frombuffer(batch.column("keys")[i].as_buffer(), dtype=np.int64)
            for at in range(0, len(keys), 200_000):
                part = keys[at : at + 200_000]
                own = [pa.array(np.full(len(part), row[c], dtype=np.int64)) for c in ("key", "rep", "label", "set")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(part), len(keys), dtype=np.int32)), pa.array(part)], names=["key", "rep", "label", "set", "n", "shingle"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def group(docs: DataFrame, percent: int = 80, size: int = SHINGLE, coordinates: int = COORDINATES, miss: float = MISS, block: int = BLOCK, rounds: int = ROUNDS, most_open: int = MOST_OPEN) -> DataFrame:
    """Group near-duplicates: (doc_id, n_shingles, component_id, kept) for each row.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable. Null and empty texts, and texts without words,
    have no shingles and are linked with nothing. Rows that repeat a doc_id are one document, which
    has the links of all its texts: such rows stay or go together. A null doc_id takes no part: its
    component is null and its row is kept. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    described = durable(describe(docs, size, coordinates), "signatures")
    usable = described.filter("doc_id IS NOT NULL AND n > 0")
    classes = durable(usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    found = links(docs.filter("doc_id IS NOT NULL"), classes, percent, size, coordinates, miss, block, rounds, most_open)
    # The classes of a document that has several texts are connected by it.
    several = usable.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    own = usable.join(several, "doc_id", "left_semi").join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(found.union(own))
    of_class = classes.join(labels, classes.rep == labels.node, "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("class_component"))
    rows = described.select("doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
