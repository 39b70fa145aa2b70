"""Exact top-k by inner product over integer vectors, pruned by Cauchy-Schwarz bounds.

Vectors are rotated into the singular basis of the whole table, so that the first coordinates carry
most of the length. Candidates are taken by falling length in blocks. For a block the product over
the first coordinates is exact up to rounding, and the rest is at most the product of the residual
lengths; only candidates whose bound reaches a query's k-th best score are scored exactly, in
integers. A query whose length times the block's longest vector stays below its k-th best is done.
Scores are 64-bit integers from the product to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.storage import durable

GROUP_ROWS = 16_384
QUERY_ROWS = 4_096
LEAST_QUERIES = 256
BLOCK_ROWS = 1_024
LEAD = 16
FOUND = "query_id long, vec_id long, score long"


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components: (key long, vector array<double>)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad
    )


def least_ids(vectors: DataFrame, keep: int) -> DataFrame:
    """Of each group of equal vectors the ``keep`` smallest ids, first within salted parts of a group.

    A search for fewer than ``keep`` neighbours, with ties to smaller ids, needs no other copies. Rows
    that repeat an id are kept up to one less than ``keep``: a query has no more of them either.
    """
    from pyspark.sql import Window

    salted = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = Window.partitionBy("v", "part").orderBy("id")
    copies = Window.partitionBy("v", "part", "id").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    first = salted.withColumn("n", F.dense_rank().over(near)).filter(F.col("n") <= keep)
    first = first.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") < keep)
    return first.withColumn("n", F.dense_rank().over(whole)).filter(F.col("n") <= keep).select("id", "v")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for d in np.unique(sizes):
            x = matrix(batch.column(1).filter(pa.array(sizes == d)))
            total[int(d)] = total.get(int(d), 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["d", "m"])


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the right singular vectors of all rows; one small matrix a partition moves."""

    def add(table: pa.Table) -> pa.Table:
        m = matrix(table.column("m")).sum(axis=0)
        return pa.table({"d": table.column("d").slice(0, 1), "m": pa.array([m], pa.list_(pa.float64()))})

    parts = vectors.select("id", "v").mapInArrow(_moments, "d int, m array<double>")
    sums = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("d", "part").applyInArrow(lambda t: add(t.drop(["part"])), "d int, m array<double>")
    out = {}
    for d, m in sums.groupBy("d").applyInArrow(add, "d int, m array<double>").collect():
        _, basis = np.linalg.eigh(np.array(m).reshape(d, d))
        out[d] = np.ascontiguousarray(basis[:, ::-1])
    return out


LARGEST = 2.0**63 - 1024  # the greatest double in the range of long
NONE = np.iinfo(np.int64).min  # a place that holds no score; scores end one above
NO_ID = np.iinfo(np.int64).max


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows; beyond the range of long, its nearest end."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    reach = np.abs(q).max() * np.abs(x).max() * q.shape[1]
    if reach < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if reach < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    # By Cauchy-Schwarz only long vectors' products can leave the range; these are taken one by one.
    q_int, x_int = q.astype(np.int64), x.astype(np.int64)
    out = q_int @ x_int.T
    for i, j in zip(*np.nonzero(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) >= 2.0**62), strict=True):
        out[i, j] = min(max(sum(a * b for a, b in zip(q_int[i].tolist(), x_int[j].tolist(), strict=True)), NONE + 1), NO_ID)
    return out


def _search(queries: pa.Table, rows: pa.Table, k: int, basis: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Each query's k best rows of the group with a score of at least the query's ``floor``."""
    sizes_q, sizes_x = np.diff(queries.column("v").combine_chunks().offsets.to_numpy()), np.diff(rows.column("v").combine_chunks().offsets.to_numpy())
    for d in np.unique(sizes_q):
        q_rows, x_rows = queries.filter(pa.array(sizes_q == d)), rows.filter(pa.array(sizes_x == d))
        if not x_rows.num_rows:
            continue
        q, x = matrix(q_rows.column("v")), matrix(x_rows.column("v"))
        q_id, x_id = q_rows.column("id").to_numpy(), x_rows.column("id").to_numpy()
        least = q_rows.column("floor").to_numpy()
        length = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((x_id, -length))
        x, x_id, length = x[order], x_id[order], length[order]
        lead = min(LEAD, int(d))
        q_turn, x_turn = q @ basis[int(d)], x @ basis[int(d)]
        q_len = np.sqrt((q * q).sum(axis=1))
        q_rest, x_rest = (np.sqrt(np.maximum((t[:, lead:] ** 2).sum(axis=1), 0)) for t in (q_turn, x_turn))
        # Room for rounding in the rotated products, far below the gap of integer scores.
        room = 1e-9 * (1 + q_len * length[0])
        best = np.full((len(q), k), NONE)
        best_id = np.full((len(q), k), NO_ID)
        for at in range(0, len(x), BLOCK_ROWS):
            block = slice(at, at + BLOCK_ROWS)
            enough = np.maximum(best[:, -1], least)
            enough = np.where(enough > NONE + 1, enough.astype(np.float64), -np.inf)
            live = np.flatnonzero(q_len * length[at] + room >= enough)
            if not len(live):
                break
            bound = q_turn[live, :lead] @ x_turn[block, :lead].T + np.outer(q_rest[live], x_rest[block]) + room[live, None]
            open_pairs = bound >= enough[live, None]
            open_pairs &= x_id[block][None] != q_id[live, None]
            some = open_pairs.any(axis=1)
            live, open_pairs = live[some], open_pairs[some]
            if not len(live):
                continue
            columns = np.flatnonzero(open_pairs.any(axis=0))
            score = np.where(open_pairs[:, columns], _products(q[live], x[block][columns]), NONE)
            score = np.where(score >= least[live, None], score, NONE)
            ids = np.where(score > NONE, x_id[block][columns][None], NO_ID)
            score, ids = np.hstack([best[live], score]), np.hstack([best_id[live], ids])
            # The k best scores with all ties of the k-th, then exact order by score and id.
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
            score = np.where(score >= kth, score, NONE)
            order = np.lexsort((ids, ~score), axis=1)[:, :k]
            best[live], best_id[live] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        found = best > NONE
        which = np.nonzero(found)[0]
        yield q_id[which], best_id[found], best[found]


def top_inner_products(queries: DataFrame, rows: DataFrame, k: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each query its k highest inner products: (query_id, rank, vec_id, score long).

    Both frames are (id, v) with integer-valued components, as from ``usable``; a query's own id is
    no candidate, ties go to the smaller id, fewer rows give fewer results, vectors of another
    length have no product. Scores are exact; one beyond the range of long is its nearest end.

    The longest vectors, one group of them, are searched first. A query's k-th best score among them
    is the floor below which no other group gives it a row, so that the groups of shorter vectors
    stop at the first block that cannot reach it.
    """
    queries, rows = durable(queries, "queries"), durable(rows.withColumn("length", _length("v")), "rows")
    turn = bases(rows)
    n = rows.count()
    n, none = rows.count(), F.lit(int(NONE)).alias("floor")

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        got = list(_search(q, x, k, turn)) if q.num_rows and x.num_rows else []
        columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    if n <= group_rows:
        return ranked(in_groups(queries.select("id", "v", none), rows.select("id", "v"), group_rows, search, FOUND), k, F.desc("score"))
    # The group ends at one (length, id); rows that repeat it are in the group together.
    ends = rows.select("length", "id").orderBy(F.desc("length"), "id").limit(group_rows).orderBy("length", F.desc("id")).first()
    among = (F.col("length") > ends.length) | ((F.col("length") == ends.length) & (F.col("id") <= ends.id))
    first = in_groups(queries.select("id", "v", none), rows.filter(among).select("id", "v"), group_rows, search, FOUND)
    first = durable(ranked(first, k, F.desc("score")), "longest")
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    held = queries.join(floors, "id", "left").select("id", "v", F.coalesce("floor", none).alias("floor"))
    second = in_groups(held, rows.filter(~among).select("id", "v"), group_rows, search, FOUND)
    return ranked(first.select("query_id", "vec_id", "score").unionByName(second), k, F.desc("score"))


def _length(v: str) -> Column:
    """The squared length, added up in the order of the components."""
    return F.aggregate(F.col(v), F.lit(0.0), lambda total, x: total + x * x)


def in_groups(queries: DataFrame, rows: DataFrame, group_rows: int, search, schema: str) -> DataFrame:
    """Run ``search(queries, rows)``, of Arrow tables, on every group of queries with every group of rows.

    Groups follow a hash of the id; their numbers follow the numbers of rows alone, so that no result
    is written oftener where more partitions are set. Queries are dealt to more groups only while the
    cluster's cores exceed the pairs of groups and a group keeps some hundred queries.
    """
    n, m = rows.count(), queries.count()
    row_groups = max(1, -(-n // group_rows))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    query_groups = max(1, -(-m // QUERY_ROWS), min(-(-m // LEAST_QUERIES), -(-cores // row_groups)))

    def dealt(frame: DataFrame, own: int, others: int, first: str, second: str) -> DataFrame:
        return frame.withColumn(first, F.pmod(F.xxhash64("id"), F.lit(own))).withColumn(second, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    left = dealt(queries, query_groups, row_groups, "a", "b")
    right = dealt(rows, row_groups, query_groups, "b", "a")

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int, by) -> DataFrame:
    """The k first of each query: (query_id, rank, vec_id, score)."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(by, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_quantised(table: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Quantise components to floor(scale * x); queries are the ids divisible by ``every``.

    Rows whose vector is null, empty or holds a null or non-finite component take no part, nor do
    null ids. Repeated ids are rows of their own except as candidates of themselves. A component
    beyond the range of long becomes its nearest end, as does a score.
    """
    whole = usable(table).withColumn("v", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x * scale))).cast("double")))
    queries = whole.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    return top_inner_products(queries, least_ids(whole, k + 1), k)
