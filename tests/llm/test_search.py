import math

import numpy as np
import pytest

from barlake.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string, id string"


def table(spark, seed=0, n=400, d=24, long_tail=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.pareto(2, size=(n, 1)) + 0.2 if long_tail else 1)
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r], "x", None) for i, r in enumerate(x)]
    same = [float(v) for v in x[3]]
    rows += [(1000 + i, same, "x", None) for i in range(60)]  # ties across many copies
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, "x", None), (2020, [nan] * d, "x", None), (2040, [inf] + [0.0] * (d - 1), "x", None), (2060, [0.0] * d, "x", None), (2080, [], "x", None)]
    rows += [(2100, [None] + [1.0] * (d - 1), "x", None), (None, [1.0] * d, "x", None), (2200, [1.0, 2.0], "x", None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def usable(rows, zero=True):
    return [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


@pytest.mark.parametrize("seed,long_tail", [(0, False), (1, True)])
def test_top_k_equals_brute_force(spark, seed, long_tail):
    rows, df = table(spark, seed, long_tail=long_tail)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in usable(rows)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_quantised(df).collect())) == sorted(want)


def test_top_k_in_many_groups_and_with_large_components(spark):
    rows, df = table(spark, 4, n=100)
    big = df.selectExpr("vec_id", "transform(embedding, x -> cast(x * 1e7 as float)) AS embedding")
    whole = topk.usable(big).selectExpr("id", "transform(v, x -> cast(floor(x) as double)) AS v")
    got = topk.top_inner_products(whole.filter("id % 10 = 0"), whole, 5, group_rows=7).collect()
    good = {r.id: [int(x) for x in r.v] for r in whole.collect()}
    for q in [i for i in good if i % 10 == 0]:
        best = sorted((-sum(a * b for a, b in zip(good[q], w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(good[q]))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best


def test_scores_beyond_doubles_and_beyond_longs(spark):
    big = 128_000_001
    rows = [(i, [(big + i % 3) / 64, 1.0 + i % 2]) for i in range(0, 50)] + [(60, [-2e6, 2e6]), (61, [1.0, 0.0]), (80, [1e30, 1.0]), (100, [-1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    end = 2**63 - 1024
    good = {i: [max(-end, min(end, math.floor(64 * x))) for x in v] for i, v in rows}
    want = []
    for q in [i for i in good if i % 20 == 0]:
        scores = ((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(good[q], w, strict=True)))), i) for i, w in good.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:20])]
    assert any(2**53 < s < 2**60 and s % 2 for *_, s in want) and any(s == 2**63 - 1 for *_, s in want)
    assert sorted(map(tuple, topk.top_quantised(df).collect())) == sorted(want)
    for group in (7, 16_384):
        whole = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in good.items()], "id long, v array<double>")
        assert sorted(map(tuple, topk.top_inner_products(whole.filter("id % 20 = 0"), whole, 20, group).collect())) == sorted(want)


def test_hadamard_is_orthonormal():
    a = np.eye(16)
    h = ann.hadamard(a)
    assert np.allclose(h @ h.T, np.eye(16))


def test_nearest_recall_scores_and_ties(spark):
    rows, df = table(spark, 2, n=900)
    good = usable(rows, zero=False)
    got = ann.nearest(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    vectors = dict(good)
    hits = total = 0
    for q, v in good:
        if q % 100:
            continue
        own = sorted(by[q], key=lambda r: r.rank) if q in by else []
        exact = sorted((math.dist(v, w), i) for i, w in good if i != q and len(w) == len(v))[:10]
        assert len(own) <= 10 and [r.rank for r in own] == list(range(1, len(own) + 1))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        for r in own:
            assert abs(r.score - math.dist(v, vectors[r.vec_id])) < 1e-12
        hits += len({i for _, i in exact} & {r.vec_id for r in own})
        total += len(exact)
    assert hits >= 0.9 * total
    assert [r.vec_id for r in sorted(by[1000], key=lambda r: r.rank)] == [3, *range(1001, 1010)]  # copies, smallest ids first


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    good = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.array([v for _, v in good], dtype=float), np.array([i for i, _ in good])
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        dist = np.linalg.norm(x - x[ids == q], axis=1)
        dist[ids == q] = np.inf
        hits += len(set(ids[np.argsort(dist)[:10]]) & found[q])
    recall = hits / (10 * len(found))
    print("recall", recall)
    assert recall >= 0.9


def test_nearest_gives_k_rows_or_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 128)) * 0.05
    x[:, 0] -= 1  # most rows point away from the query 0 and from 100
    x[0], x[100] = -x[0], -x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400 + i, [float(v) for v in r]) for i, r in enumerate(np.eye(8))]  # fewer than k others, all orthogonal
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), group_rows=64).collect():
        got.setdefault(r.query_id, []).append(r)
    for q, v in rows:
        if q % 100 == 0:
            own = sorted(got[q], key=lambda r: r.rank)
            others = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
            assert [r.rank for r in own] == list(range(1, min(10, len(others)) + 1))
            if q in (0, 100, 400):
                assert [r.vec_id for r in own] == [i for _, i in others[:10]]


def test_repeated_rows_leave_copies_under_other_ids(spark):
    rows = [(0, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(1, 26)] + [(50, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for found, k in ((topk.top_quantised(df), 20), (ann.nearest(df), 10)):
        got = {r["rank"]: r.vec_id for r in found.collect() if r.query_id == 0}
        assert got == {n: n for n in range(1, k + 1)}
    other = {r["rank"]: r.vec_id for r in topk.top_quantised(df).collect() if r.query_id == 20}
    assert other == {n: 0 for n in range(1, 21)}  # repeated rows are candidates of their own


def test_only_probed_candidates_are_measured(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = topk.usable(df)
    rows, queries = ann.indexed(vectors, ann.TABLES, 1, 7, "float"), ann.indexed(vectors.filter("id % 100 = 0"), ann.TABLES, ann.PROBES, 7, "float")
    placed, probing = ann.probed_pairs(queries, rows, ann.TABLES, 50)
    key = ["d", "t", "bucket", "part"]
    pairs = probing.select(*key, probing.id.alias("q")).join(placed.select(*key, "row"), key)
    computed, distinct, every = pairs.count(), pairs.select("q", "row").distinct().count(), queries.count() * rows.count()
    print("computed", computed / every, "distinct", distinct / every)
    assert computed <= 0.5 * every and distinct <= 0.4 * every
    assert placed.groupBy(*key).count().agg({"count": "max"}).first()[0] <= 150 and placed.count() == ann.TABLES * rows.count()


def test_vectors_of_extreme_length(spark):
    rows = [(0, [1e200, 0.0]), (100, [1e-200, 0.0]), (1, [1e200, 1e190]), (2, [2e-200, 0.0]), (3, [0.0, 1e-200]), (4, [5.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q, v in [r for r in rows if r[0] % 100 == 0]:
        want = sorted((math.dist(v, w), i) for i, w in rows if i != q)
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == [i for _, i in want] and np.allclose([r.score for r in own], [d for d, _ in want], rtol=1e-12, atol=0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_quantised(empty).collect() == [] and ann.nearest(empty).collect() == []
