import random

import pytest

from barlake.llm import graph, neardup

SCHEMA = "doc_id long, text string, label string, key int"


def shingles(text, size=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = text.encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([tuple(w)])


def brute_force(rows, percent):
    """Rows that share a doc_id are one document; null ids take no part."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in sets:
        if i is not None:
            for x in s:
                index.setdefault(x, set()).add((i, s))
    for i, s in sets:
        if i is None:
            continue
        for j, t in {y for x in s for y in index[x]}:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def cloud(rng, n, base_words=120, edits=12, vocab=40):
    """Near copies of one text at many distances."""
    base = [f"v{rng.randrange(vocab)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for size, edits in ((90, 6), (12, 3), (3, 1), (2, 2), (25, 10)):
        texts += cloud(rng, size, rng.choice([30, 80, 200]), edits)
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 7, 9, 60]))) for _ in range(60)]
    texts += ["One two", "one TWO", "three", "", None, " \t", "É a b c d e", "é a b c d e", texts[0], texts[0], texts[5].upper()]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


def check(spark, rows, **options):
    got = neardup.group(frame(spark, rows), **options).collect()
    want = brute_force(rows, options["percent"])
    assert sorted([tuple(r) for r in got], key=str) == want
    assert len({r.component_id for r in got}) < len(rows)


@pytest.mark.parametrize("seed,percent,block", [(1, 85, 256), (2, 80, 16), (3, 85, 7)])
def test_equals_brute_force(spark, seed, percent, block):
    check(spark, corpus(seed), percent=percent, block=block)


@pytest.mark.parametrize("percent,step", [(85, 15), (80, 20)])
def test_chain_of_links_at_the_exact_threshold(spark, percent, step):
    words = [f"w{i}" for i in range(104 + 4 * step)]
    texts = []
    for at in range(0, 4 * step, step):  # 100 - step shingles, then 100, then 100 - step of these
        texts += [" ".join(words[at : at + 104 - step]), " ".join(words[at : at + 104])]
    rows = list(enumerate(texts))
    assert {i[2] for i in brute_force(rows, percent)} == {0}
    for block in (2, 256):
        check(spark, rows, percent=percent, block=block)


def test_trimmed_at_both_ends_beside_many_variants(spark):
    # 17 of 20 shingles in common, exactly 85 in 100, while both are variants of a text with 300 others.
    words = [f"w{i}" for i in range(24)]
    rows = [(0, " ".join(words[:21])), (1, " ".join(words)), (2, " ".join(words[3:]))]
    rows += [(3 + i, " ".join([*words[:21], f"v{i}"])) for i in range(300)]
    got = {r.doc_id: r.component_id for r in neardup.group(frame(spark, rows), percent=85).collect()}
    assert set(got.values()) == {0}
    check(spark, rows, percent=85)


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_pairs_at_the_threshold_among_hundreds_of_variants(spark, percent, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(140)]
    texts = []
    for _ in range(330):  # contiguous pieces of one text: similarities of many exact fractions
        n = rng.choice([36, 38, 44, 49, 52, 55, 64, 72, 84, 89, 104])  # also 85 and 80 in 100 of one another
        at = rng.randrange(0, 140 - n, rng.choice([1, 3, 4, 5]))
        texts.append(" ".join(words[at : at + n]))
    texts += [" ".join([*words[:100], f"u{i}"]) for i in range(60)]
    texts += [" ".join(words[i : i + 100]) for i in range(0, 40, 20 if percent == 80 else 15)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    exact = sum(100 * len(s & t) == percent * len(s | t) for i, s in enumerate(map(shingles, texts)) for t in map(shingles, texts[:i]))
    assert exact > 10
    for rounds, block in ((1, 128), (0, 16)) if seed % 2 else ((2, 40),):
        check(spark, rows, percent=percent, rounds=rounds, block=block)


def test_hot_list_is_dealt_to_small_tasks(spark):
    # A third of all texts are variants of one; no task may grow with their number.
    rng = random.Random(5)
    texts = cloud(rng, 700, 120, 4, 10**6) + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    rows = list(enumerate(texts))
    lists = spark.createDataFrame([(k, i, 0 if i < 500 else i) for k in range(3) for i in range(700)], "key long, rep long, label long")
    for tasks in (neardup._stars(neardup._hub_pairs(lists), 32), neardup._open_lists(lists, 32)):
        assert tasks.groupBy("task", "x", "y").count().agg({"count": "max"}).first()[0] <= 3 * 32
    assert neardup._open_lists(lists, 32).filter("x >= 0 AND side = 0").count() <= 3 * 500 * 10
    check(spark, rows, percent=85)


@pytest.mark.parametrize("seed,percent", [(6, 85), (7, 80)])
def test_wide_families_by_their_rarest_shingles(spark, seed, percent):
    check(spark, corpus(seed), percent=percent, most_open=0)


def template(rng, n, shared=100, own=24):
    """Pages of one template: near one another, and none linked but the pairs at the end."""
    head = [f"t{i}" for i in range(shared)]
    pages = [" ".join(head + [f"u{rng.randrange(10**7)}" for _ in range(own)]) for _ in range(n)]
    return pages + [" ".join([*pages[i].split()[:-1], "other"]) for i in range(0, n, 50)]


def test_pages_of_a_template_meet_in_no_list(spark):
    texts = template(random.Random(3), 300)
    rows = list(enumerate(texts))
    check(spark, rows, percent=85, most_open=10)
    sets = frame(spark, rows).select("doc_id", "text").mapInArrow(neardup._with_sets(5, 48), "rep long, n int, sig binary, keys binary")
    members = spark.createDataFrame([(1, i, i) for i, _ in rows], "key long, rep long, label long")
    lists = neardup.rare_lists(members, sets, 85)
    # Only a page and its copy share rare shingles; of 306 * 305 / 2 pairs few more are compared.
    assert lists.groupBy("key").count().filter("count > 2").count() == 0 and lists.count() < 10 * len(rows)


def test_a_very_long_text_and_its_near_copy(spark):
    words = [f"w{i % 7919}x{i % 31}" for i in range(400_000)]  # beyond one slice of the splitter
    near = list(words)
    near[1000:1010] = ["changed"] * 10
    rows = [(5, " ".join(words)), (2, " ".join(near)), (3, None), (4, "w1x1 w2x2"), (6, " ".join(words[:200_000]))]
    assert len(rows[0][1]) > 2_000_000
    check(spark, rows, percent=85)


def test_null_and_repeated_ids(spark):
    rows = corpus(4)[:60]
    rows += [(rows[3][0], rows[9][1]), (rows[3][0], rows[3][1]), (None, rows[3][1]), (None, None)]
    check(spark, rows, percent=85)
    check(spark, rows, percent=85, most_open=0)


def test_empty_table(spark):
    assert neardup.group(frame(spark, [])).collect() == []


def test_least_matches_bounds_the_miss():
    m = neardup.least_matches(48, 0.85, 1e-7)
    assert 20 <= m <= 30 and neardup.least_matches(48, 1.0, 1e-7) == 48


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 300, 301: 300}
    assert got == want
