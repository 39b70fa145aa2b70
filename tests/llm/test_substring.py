import hashlib
import random

import pytest

from barlake.llm import substring


def brute_force(rows, window):
    """By the definition: windows judged on the input, smaller doc_id wins."""
    least = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if doc is not None:
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é x", "\x1c", "long" * 100]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(8)]
    rows = []
    for doc in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                words += p[rng.choice([0, 0, 1, 5]) :]
        rows.append((doc, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (502, None), (502, ""), (503, "a " * 500), (504, "a " * 700)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, block int").repartition(3)


@pytest.mark.parametrize("window,seed", [(50, 1), (50, 2), (7, 3), (1, 4)])
def test_equals_brute_force(spark, window, seed):
    rows = corpus(seed)
    got = substring.remove_repeats(frame(spark, rows), window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_force(rows, window)
    assert any(r.n_removed for r in got)


def test_narrow_sketches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "CELLS_PER_ANCHOR", 1)
    monkeypatch.setattr(substring, "MAX_WIDTH", 1024)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    rows = corpus(6)
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_force(rows, 50)


def test_with_text_keeps_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage + "  tail one"), (2, "head\n" + passage + " tail two"), (3, "clean  text\nstays")]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows), with_text=True).collect()}
    assert got[1].text == passage + "  tail one" and got[3].text == "clean  text\nstays"
    assert got[2].text == "head two"  # "tail" ends a window that repeats too
    assert all(r.key == "k" and r.block == 1 for r in got.values())


def test_columns_named_like_figures_stay(spark):
    rows = [(i, " ".join(f"p{j}" for j in range(60)), "mine", "k") for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, KEPT_SHA256 string")
    got = {r.doc_id: r for r in substring.remove_repeats(df, with_text=True).collect()}
    assert all(r.n_words == "mine" and r.KEPT_SHA256 == "k" for r in got.values()) and got[2].n_removed == 60
    plain = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert plain[2].n_words == 60 and len(plain[2].kept_sha256) == 64


def test_empty_table(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []
