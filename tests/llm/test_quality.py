import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from barlake.llm import quality, textops
from barlake.llm.storage import durable

DOCS = "doc_id long, text string, lang string, n_words int, quality string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def brute_force_model(texts):
    """P(w | u v) straight from the definition of interpolated modified Kneser-Ney."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split()]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def off(counts):
        """Discounts from Chen and Goodman's formulas, kept within their counts."""
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = {c: c - (c + 1) * y * n[c + 1] / n[c] if n[c] else c * y for c in (1, 2, 3)}
        d = {c: min(max(x, 0.05), c - 0.05) for c, x in d.items()}
        return lambda c: d.get(min(c, 3), 0.0)

    o1, o2, o3 = off(uni), off(bi), off(tri)
    words = len(set(uni) | {"<s>"})
    total = sum(uni.values())
    by_v, by_uv = defaultdict(list), defaultdict(list)
    for (v, _), c in bi.items():
        by_v[v].append(c)
    for (u, v, _), c in tri.items():
        by_uv[u, v].append(c)

    def p(u, v, w):
        p1 = sum(map(o1, uni.values())) / total / (words + 1) + (uni[w] - o1(uni[w])) / total
        p2 = p1
        if v in by_v:
            s = sum(by_v[v])
            p2 = (bi[v, w] - o2(bi[v, w])) / s + sum(map(o2, by_v[v])) / s * p1
        if (u, v) in by_uv:
            s = sum(by_uv[u, v])
            return (tri[u, v, w] - o3(tri[u, v, w])) / s + sum(map(o3, by_uv[u, v])) / s * p2
        return p2

    return p


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    train = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    table, unknown = quality.count_table(train)
    p = brute_force_model(texts)
    tests = [*texts[:10], "w1 never w2 w1 w2 seen", "w3", "<s> w1"]
    rows = [(i, t, "en") for i, t in enumerate(tests)] + [(98, None, "en"), (99, "", None)]
    docs = durable(frame(spark, rows).select("doc_id", "text", "lang").repartition(3), "texts")
    got = {r.doc_id: r for r in quality.perplexities(docs, table, unknown).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(tests):
        w = ["<s>", "<s>", *t.split()]
        # "<s>" in a text is an ordinary word there, unknown to the model
        want = -sum(math.log(p(*(x if x != "<s>" or j + k < 2 else "?" for k, x in enumerate(g)))) for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)))
        assert abs(got[i].nll - want) < 1e-4 * max(1, want), t
    assert got[98].n_words == got[99].n_words == 0


def test_probabilities_sum_to_one(spark):
    table, unknown = quality.count_table(frame(spark, [(1, "a b a c a b d a a", "en"), (2, "b b c", "en")]))
    share = {r.key: (r.a, r.b) for r in table.collect()}
    hashes = {x: textops.word_hashes(next(textops.split_words(pa.array([x]))))[:1] for x in "abcdz"} | {"<s>": np.array([quality.START])}
    key = lambda *x: int(quality._key(*(hashes[y] for y in x))[0] >> np.uint64(64 - quality.KEY_BITS))
    of = lambda *x: share.get(key(*x), (0.0, 1.0))
    for u, v in (("a", "b"), ("b", "d"), ("z", "a"), ("z", "z"), ("<s>", "<s>"), ("<s>", "a")):
        p = {w: of(u, v, w)[0] + of(u, v)[1] * (of(v, w)[0] + of(v)[1] * (unknown + of(w)[0])) for w in ("a", "b", "c", "d", "z", "<s>")}
        assert abs(sum(p.values()) - 1) < 1e-9  # z stands for all unknown words


def test_several_groups_and_unstable_frames(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUP_CHARS", 500)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))), "en") for i in range(80)]
    docs = frame(spark, rows).repartition(7)
    table, unknown = quality.count_table(docs.filter("doc_id < 30"))
    texts = durable(docs.select("doc_id", "text", "lang"), "texts")
    many = {r.doc_id: round(r.nll, 9) for r in quality.perplexities(texts, table, unknown).collect()}
    monkeypatch.setattr(quality, "GROUP_CHARS", 10**9)
    assert many == {r.doc_id: round(r.nll, 9) for r in quality.perplexities(texts, table, unknown).collect()} and len(many) == 80


def test_held_out_accuracy_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels, max_docs=1500, max_chars=4_000_000)
    table = {(r.quality, r.keep): r["count"] for r in got.join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    rejected_good = table.get((1, False), 0) / (table.get((1, False), 0) + table[1, True])
    rejected_bad = table[0, False] / (table[0, False] + table.get((0, True), 0))
    print(table)
    assert rejected_good <= 0.01 and rejected_bad >= 0.75


def test_bounds_nulls_and_missing_labels(spark):
    rows = [(i, "good words stand here in order now", "en") for i in range(30)] + [(None, "zz qq", None), (100, None, "en"), (101, "", "xx"), (102, "$$ %% &&" * 30, "en"), (102, "again", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels, max_docs=10, min_trusted=1).collect()
    assert len(got) == len(rows)
    assert all(r.keep for r in got if r.doc_id in (100, 101) or (r.doc_id or 999) < 30)
    assert [r.perplexity for r in got if r.doc_id in (100, 101)] == [None, None]
    nothing = quality.classify(frame(spark, rows), labels.filter("quality = 7")).collect()
    assert len(nothing) == len(rows) and all(r.keep for r in nothing)
    assert quality.classify(frame(spark, []), labels).collect() == []
    sample = quality.trusted_sample(frame(spark, rows), labels.filter("quality = 1 and doc_id is not null"), 10, 100)
    assert 0 < sample.count() <= 2


def test_long_trusted_document_keeps_no_others_out(spark):
    ids = [r.id for r in spark.range(60).selectExpr("id", "xxhash64(id) AS h").filter("h >= 0").orderBy("h").collect()]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "word " * 1000 if i == ids[0] else "good words stand here in order", "en") for i in range(60)]
    docs = frame(spark, rows)
    sample = {r.doc_id: r.text for r in quality.trusted_sample(docs, labels, 1000, 1000).collect()}
    assert set(sample) == set(ids[1:]) and all(t == "good words stand here in order" for t in sample.values())
    got = quality.classify(docs, labels, max_chars=1000, min_trusted=1).collect()
    assert len(got) == 60 and all(r.score is not None for r in got)
    only = [r.text for r in quality.trusted_sample(docs.filter(f"doc_id = {ids[0]}"), labels, 1000, 1000).collect()]
    assert only == ["word " * 200]


def test_all_trusted_text_trains(spark):
    ids = [r.id for r in spark.range(9000).selectExpr("id", "xxhash64(id) AS h").filter("h >= 0").orderBy("h").collect()]
    assert len(ids) > 4200
    texts = {i: "good words stand here in order" for i in range(9000)} | {ids[-1]: "quaint violets bloom under glass roofs"}
    rows = [(i, t, "en") for i, t in texts.items()] + [(9001, "quaint violets bloom under glass roofs", "en"), (9002, "strange thistles fade beside stone walls", "en")]
    labels = spark.range(9000).selectExpr("id AS doc_id", "1 AS quality")
    got = {r.doc_id: r.perplexity for r in quality.classify(frame(spark, rows), labels).filter("doc_id > 9000").collect()}
    assert got[9001] < got[9002] / 2  # the last trusted document in the order of the hash taught its words


def test_shards_and_filters_follow_the_table_and_change_no_score(spark, monkeypatch):
    assert quality.layout(10, 10) == (quality.SHARD_BITS, 1024)
    bits = [quality.layout(n, 60 * n) for n in (10**6, 10**7, 10**8, 10**9)]
    assert all(f << s <= quality.FILTER_BITS for s, f in bits) and bits[-1][1] == 0
    assert all(10**k >> s <= quality.GROUP_GRAMS >> quality.SHARD_BITS for k, (s, _) in zip((6, 7, 8, 9), bits, strict=True))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(50)]) for _ in range(rng.randint(1, 40))), "en") for i in range(60)]
    texts = durable(frame(spark, rows).select("doc_id", "text", "lang"), "texts")
    table, unknown = quality.count_table(texts.filter("doc_id < 20"))
    scores = lambda: {r.doc_id: round(r.nll, 9) for r in quality.perplexities(texts, table, unknown).collect()}
    filtered = scores()
    monkeypatch.setattr(quality, "FILTER_BITS", 1)
    monkeypatch.setattr(quality, "GROUP_GRAMS", 50)
    assert scores() == filtered and len(filtered) == 60


def test_split_words_and_rare_words_change_no_score(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["the", "the", "the", *(f"w{i}" for i in range(40))]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    tests = [*texts[:6], "the w1 the never the w2", "the", "never the", ""]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(tests)]).repartition(3)
    train = frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    p = brute_force_model(texts)
    want = [-sum(math.log(p(*g)) for g in zip(w, w[1:], w[2:], strict=False)) for w in (["<s>", "<s>", *t.split()] for t in tests)]
    for frequent, grams in ((5, 1 << 30), (5, 1600), (1 << 18, 1600)):
        monkeypatch.setattr(quality, "FREQUENT", frequent)  # the shares of other words are joined last
        monkeypatch.setattr(quality, "GROUP_GRAMS", grams)  # a word with more than a sixteenth of them is split
        table, unknown = quality.count_table(train)
        assert (table.pairs is not None) == (grams == 1600)
        if table.pairs is not None:
            assert len(table.deal.words) == 1 and len({shard for _, shard in table.deal.shards()}) > 1
        got = {r.doc_id: r.nll for r in quality.perplexities(docs, table, unknown).collect()}
        assert len(got) == len(tests) and all(abs(got[i] - x) < 1e-6 for i, x in enumerate(want))


def test_rows_between_stages_are_packed(spark):
    """Neither the counts nor the questions take a row for each word."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(100)), "en") for i in range(200)]
    docs = frame(spark, rows).coalesce(2)
    table, unknown = quality.count_table(docs.filter("doc_id < 100"))
    held = table.trigrams.collect()
    assert len(held) <= 1 << quality.SHARD_BITS
    packed = sum(len(r[c]) for r in held for c in ("words", "u", "v", "w", "c"))
    assert sum(r.n for r in held) > 9000 and packed < 12 * sum(r.n for r in held)
    assert {r.doc_id for r in quality.perplexities(docs, table, unknown).collect()} == set(range(200))


def test_passes_change_no_score(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(20)), "en") for i in range(60)] + [(None, "w1 w2", "en"), (7, "w1", "en")]
    docs = frame(spark, rows)
    scores = lambda: sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.nll, 9)) for r in quality.perplexities(docs, *quality.count_table(docs.filter("doc_id < 30"), 400)).collect()))
    once = scores()
    monkeypatch.setattr(quality, "PASS_CHARS", 100)
    assert scores() == once and len(once) == 62
