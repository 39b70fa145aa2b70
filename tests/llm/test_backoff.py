import math
from collections import Counter

import pytest

from barlake.llm import backoff


def brute_force(texts, alpha=0.4):
    docs = [(t or "").encode().split() for t in texts]
    total, own = Counter(), []
    for w in docs:
        c = Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        own.append(c)
        total += c
    n = sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own, strict=True):
        others = lambda g, mine=mine: total[g] - mine[g]
        levels, score = Counter(), 0.0
        for i in range(len(w)):
            used = min(i + 1, 3)
            penalty = 0
            while used > 1 and not others(tuple(w[i - used + 1 : i + 1])):
                used, penalty = used - 1, penalty + 1
            gram = tuple(w[i - used + 1 : i + 1])
            if others(gram):
                p = others(gram) / (others(gram[:-1]) if used > 1 else n - len(w))
            else:
                used, p = 0, 1 / (n - len(w) + 1)
            levels[used] += 1
            score += math.log(p) + penalty * math.log(alpha)
        out.append((len(w), levels[3], levels[2], levels[1], levels[0], score))
    return out


TEXTS = ["a b c a b d", "a b c", "a b c", "x", "", None, "y y y y y", "b c  a\tb\nc \x1c é", "a b c a b c a b c", "word " * 3000 + "end"]


@pytest.mark.parametrize("stable,block", [(False, 8_000_000), (False, 30), (True, 8_000_000)])
def test_equals_brute_force(spark, monkeypatch, stable, block):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", block)
    rows = [(i, t, 5, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, shard string").coalesce(2)
    got = {r.doc_id: r for r in backoff.score(df, stable=stable).collect()}
    assert len(got) == len(TEXTS)
    for i, want in enumerate(brute_force(TEXTS)):
        r = got[i]
        assert (r.n_words, r.n_trigram, r.n_bigram, r.n_unigram, r.n_unseen) == want[:5], (i, TEXTS[i], r)
        assert abs(r.log_score - want[5]) < 1e-8


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_bigram) for r in backoff.score(df).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1)]


def test_empty_table(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
