import random
import zlib

import duckdb
import pandas as pd
import pytest

from barlake.llm import rolling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, event_s string"


def when(doc):
    return None if doc is None else 60 * ((doc + zlib.crc32(str(doc).encode()) % 4000) // 6)


def brute_force(rows, windows):
    out = []
    for doc, _, _, source, *_ in rows:
        for w in windows:
            t = when(doc)
            held = [] if t is None else [r for r in rows if r[3] == source and r[0] is not None and t - w <= when(r[0]) < t]
            sizes = sorted(len(r[1]) for r in held if r[1] is not None)
            m = len(sizes)
            ranks = (sizes[-(-m // 2) - 1], sizes[-(-75 * m // 100) - 1]) if m else (None, None)
            out.append((doc, w, t, len(held), sum(sizes), len({r[2] for r in held if r[2] is not None}), *ranks))
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "é" * rng.randint(1, 9), "x" * rng.randint(1, 400), "wörd " * rng.randint(1, 30)])
        rows.append((i, text, rng.choice(["en", "de", "fr", None]), rng.choice(["hot", "hot", "hot", "cold", None, ""]), -1, "k", "e"))
    rows += [rows[7]] * 30 + [(7, "other text", "es", rows[7][3], 0, "k", "e"), (None, "no id", "en", "hot", 0, "k", "e"), (-5, "below", "en", "hot", 0, "k", "e")]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted([(r.doc_id, r.window_s, r.event_s, r.n_events, r.sum_chars, r.n_langs, r.median_chars, r.high_chars) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed,windows,chunk_s", [(1, (3600, 21600), None), (2, (600, 60), 7000), (3, (3600, 21600), 3000), (4, (1, 5000), 10**9)])
def test_equals_brute_force(spark, seed, windows, chunk_s):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(rolling.features(df, windows, chunk_s)) == brute_force(rows, windows)


def test_dense_sources_equal_sql(spark):
    """Ids close together: windows of hundreds of rows, many values alike, a very long text."""
    rng = random.Random(9)
    rows = [(i, "y" * rng.choice([1, 2, 2, 3, 50, rng.randint(0, 99)]), rng.choice(["a", "b", "c"]), rng.choice("st"), 0) for i in range(2_500)] + [(2_500, "z" * 3_000_000, "d", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = [tuple(None if pd.isna(x) else int(x) for x in r) for r in con.execute(f"SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars FROM ({rolling.ORACLE_SQL})").df().itertuples(index=False)]
    assert got(rolling.features(df)) == sorted(want, key=str)


def test_empty_table(spark):
    assert rolling.features(spark.createDataFrame([], SCHEMA)).collect() == []
