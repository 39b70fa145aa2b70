"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A unit vector's
bucket in a table is the signed axis nearest to its rotation. A query probes, in every table, the
axes it is nearest to. Rows and queries meet by (table, bucket): a query is sent to the buckets it
probes and to no others, and there every distance that is computed is that of a probed candidate.
Each bucket gives a query its k nearest; the tables' results merge by query. Queries whose probes
meet fewer than k rows are searched again over all rows, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import topk
from barlake.llm.storage import durable

TABLES = 18
PROBES = 3
ROUNDS = 3
GROUP_ROWS = 16_384
CHUNK = 256
DTYPES = {"float": np.float32, "double": np.float64}
FOUND = "query_id long, vec_id long, row long, score double"


def hadamard(a: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = a.shape
    h = 1
    while h < width:
        a = a.reshape(n, width // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return a / np.sqrt(width)


def signs(width: int, table: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, table]).choice([-1.0, 1.0], (ROUNDS, width))


def axis_products(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Each unit vector's products with the 2d signed axes after the table's pseudo-rotation."""
    width = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    a = np.zeros((len(unit), width))
    a[:, : unit.shape[1]] = unit
    for s in signs(width, table, seed):
        a = hadamard(a * s)
    return np.hstack([a, -a])


def _coded(tables: int, probes: int, seed: int, kind: str):
    """Each vector, packed, with its buckets: for every table the ``probes`` signed axes it is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x = topk.matrix(part.column(1))
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                near = []
                for t in range(tables):
                    products = axis_products(unit, t, seed)
                    most = min(probes, products.shape[1])
                    near.append(np.argpartition(-products, most - 1, axis=1)[:, :most])
                codes = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(near, axis=1).astype(np.int32).ravel()), tables * most).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), part.column(0), _packed(x.astype(DTYPES[kind])), codes], names=["d", "id", "v", "codes"])

    return run


def indexed(vectors: DataFrame, tables: int, probes: int, seed: int, kind: str) -> DataFrame:
    """(d, id, v, codes, row) of (id, v): written once, a number for each row."""
    coded = vectors.select("id", "v").mapInArrow(_coded(tables, probes, seed, kind), "d int, id long, v binary, codes array<int>")
    return durable(coded.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, which Spark moves as they are."""
    x = np.ascontiguousarray(x)
    offsets = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _distances(queries: pa.Table, rows: pa.Table, k: int, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The k nearest rows of each query; every row is a candidate of every query of its length."""
    for d in np.unique(queries.column("d").to_numpy()):
        q_rows, x_rows = (t.filter(pa.compute.equal(t.column("d"), int(d))) for t in (queries, rows))
        if not x_rows.num_rows:
            continue
        q, x = (np.frombuffer(b"".join(t.column("v").to_pylist()), DTYPES[kind]).reshape(-1, d).astype(np.float64) for t in (q_rows, x_rows))
        q_id, x_id, x_row = q_rows.column("id").to_numpy(), x_rows.column("id").to_numpy(), x_rows.column("row").to_numpy()
        for at in range(0, len(q), CHUNK):
            part = slice(at, at + CHUNK)
            which, column, score = _rerank(q[part], q_id[part], x, x_id, k)
            yield q_id[part][which], x_id[column], x_row[column], score


def _rerank(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest others of each query; those in reach are computed directly."""
    other = x_id[None] != q_id[:, None]
    scale = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None]
    with np.errstate(invalid="ignore", over="ignore"):
        rough = np.where(other, scale - 2 * (q @ x.T), np.inf)
    room = 1e-9 * (1 + scale.max())
    # Squares beyond the range of doubles say nothing: all candidates are then computed directly.
    if len(x) > k and np.isfinite(room):
        reach = np.partition(rough, k - 1, axis=1)[:, k - 1]
    else:
        reach = np.full(len(q), np.inf)
    which, column = np.nonzero(other & ~(rough > (reach + room)[:, None]))
    apart = np.abs(q[which] - x[column])
    largest = apart.max(axis=1, initial=0.0)
    safe = np.where((largest > 1e150) | ((largest > 0) & (largest < 1e-150)), largest, 1.0)
    score = safe * np.sqrt(((apart / safe[:, None]) ** 2).sum(axis=1))
    order = np.lexsort((x_id[column], score, which))
    which, column, score = which[order], column[order], score[order]
    start = np.searchsorted(which, which)
    first = np.arange(len(which)) - start < k
    return which[first], column[first], score[first]


def _met(k: int, kind: str):
    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        got = list(_distances(q, x, k, kind)) if q.num_rows and x.num_rows else []
        columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [*[np.zeros(0, np.int64)] * 3, np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "row", "score"), columns, strict=True)))

    return run


def probed_pairs(queries: DataFrame, rows: DataFrame, tables: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, as from ``indexed``, under (d, t, bucket, part): a row once a table, a query where it probes.

    A bucket of more than ``group_rows`` rows is dealt by the id to several parts, and the queries
    that probe it are sent to all of them, so that no bucket is one task's.
    """
    key = ["d", "t", "bucket"]

    def posted(frame: DataFrame) -> DataFrame:
        each = F.posexplode("codes").alias("at", "bucket")
        t = F.floor(F.col("at") * tables / F.col("n")).cast("int").alias("t")
        return frame.select("d", "id", "v", "row", F.size("codes").alias("n"), each).select("d", t, "bucket", "id", "v", "row")

    placed, probing = posted(rows), posted(queries)
    parts = placed.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("parts")).filter("parts > 1")
    parts = F.broadcast(durable(parts, "large-buckets"))  # at most one row for each group_rows rows and table
    one = F.coalesce("parts", F.lit(1))
    placed = placed.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64("id"), one).cast("int")).drop("parts")
    probing = probing.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return placed, probing


def nearest(table: DataFrame, every: int = 100, k: int = 10, tables: int = TABLES, probes: int = PROBES, seed: int = 7, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` its k nearest others found: k, or all if fewer.

    Returns (query_id, rank, vec_id, score), the score the Euclidean distance of the given vectors
    in double precision, ties to the smaller id. Rows whose vector is null, empty, zero or holds a
    null or non-finite component take no part, nor do null ids; vectors of another length are no
    candidates; equal vectors are all found, through the smallest ids. Every usable row is indexed.
    """
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    whole = topk.usable(table).filter(F.exists("v", lambda x: x != 0))
    # Floats are moved as floats; a row's number tells apart rows that repeat an id.
    rows = indexed(topk.least_ids(whole, k + 1), tables, 1, seed, kind)
    queries = indexed(whole.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"]), tables, probes, seed, kind)
    placed, probing = probed_pairs(queries, rows, tables, group_rows)
    key = ["d", "t", "bucket", "part"]
    met = probing.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(_met(k, kind), FOUND)
    met = met.distinct()  # a pair may meet in several tables
    found = durable(topk.ranked(met, k, F.asc("score")), "probed")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = durable(queries.join(full, queries.id == full.query_id, "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    exact = topk.in_groups(short, rows, group_rows, _met(k, kind), FOUND)
    return found.join(full, "query_id", "left_semi").select(found.columns).unionByName(topk.ranked(exact, k, F.asc("score")))
