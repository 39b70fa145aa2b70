import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlake.llm import textops, toxicity

DOCS = "doc_id long, text string, score string, margin string, features string"
FILLER = "the river runs past old stones and every autumn people walk along its banks with their dogs while boats drift slowly towards sea".split()
INVENTED = ["zorblat", "zorblen", "zorblit", "quaxig"]  # abuse in no list: learned from labels
HIDDEN = ["1d1ot", "m.o.r.o.n", "s t u p i d", "looooser", "p@thetic"]


def corpus(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            kind = rng.choice([INVENTED, HIDDEN, ["idiot", "Scum!", "WORTHLESS"]])
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(kind) if rng.random() < 0.8 else "you " + rng.choice(kind))
        elif rng.random() < 0.2:
            words = [w.upper() + "!!" for w in words]  # loud, not toxic
        docs.append((i, " ".join(words), "s", "m", "f"))
        if rng.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def auc(rows):
    good, bad = ([s for s, t in rows if t == k] for k in (0, 1))
    return np.mean([(b > g) + 0.5 * (b == g) for g in good for b in bad])


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus(1, 1500)
    extra = [(5000, None, "s", "m", "f"), (5001, "", "s", "m", "f"), (None, "you idiot", "s", "m", "f"), (5002, docs[0][1], "s", "m", "f"), (5002, docs[0][1], "s", "m", "f"), (5003, "the river " * 300_000 + "you stupid idiot moron", "s", "m", "f")]
    table = spark.createDataFrame(docs + extra, DOCS).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return toxicity.score(table, known).collect(), {d: t for d, _, t in labels}


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 200 and auc(held) > 0.99
    caught = np.mean([s >= 0.5 for s, t in held if t])
    false = np.mean([s >= 0.5 for s, t in held if not t])
    assert caught > 0.95 and false < 0.02


def test_one_row_each_within_bounds(scored):
    rows, labels = scored
    assert len(rows) == 1506 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5000][0].score == by_id[5001][0].score < 0.5  # null and empty texts are scored alike
    assert [r.score for r in by_id[5002]] == [by_id[0][0].score] * 2 and by_id[None][0].held_out is False


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(2, 400)
    table = spark.createDataFrame(docs, DOCS)
    held = {r.doc_id for r in table.filter(toxicity.remainder(F.col("doc_id")) == 0).collect()}
    flipped = [(d, q, 1 - t if d in held else t) for d, q, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("labels,share", [([], 0.0), ([(i, 1, 0) for i in range(50)], 0.0), ([(i, 1, 1) for i in range(50)], 1.0)])
def test_without_both_classes_the_share(spark, labels, share):
    rows = toxicity.score(spark.createDataFrame(corpus(3, 60)[0], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in rows} == {share} and len(rows) == 60


def test_empty_table(spark):
    labels = spark.createDataFrame(corpus(3, 60)[1], "doc_id long, quality int, toxic int")
    assert toxicity.score(spark.createDataFrame([], DOCS), labels).collect() == []


def features(*texts):
    reader = toxicity.Reader(np.zeros(0, np.uint64), np.zeros(0))
    return [dict(zip(toxicity.FEATURES, x, strict=True)) for words in textops.split_words(pa.array(texts)) for x in reader(words)]


def test_features_of_a_text():
    plain, hidden, far, loud, spelled = features("you are an idiot, sir", "an 1d1ot and a m-o*r.o.n", "you walk past many of the old stones idiot", "ÉTÉ HOT!! YES", "so s t u p i d now")
    assert plain["listed"] == 1 / 5 and plain["near_you"] == 1 / 5 and plain["pronouns"] == 1 / 5 and plain["disguised"] == 0
    assert hidden["listed"] == 2 / 5 and hidden["disguised"] == 2 / 5 and hidden["disguised_listed"] == np.log1p(2) and hidden["near_you"] == 0
    assert far["near_you"] == 0 and far["listed"] == 1 / 9
    assert loud["capital_words"] == 1 and loud["exclamation"] == 2 / 13 and loud["repeated_signs"] == 1 / 13
    assert spelled["spaced"] == 6 / 8 and spelled["disguised_listed"] == np.log1p(1)


def test_slices_and_rows_don_t_mix():
    texts = ["s t u", "p i d", "you", "idiot", "", "x" * textops.SLICE_BYTES, "you idiot"]
    alone = [features(t)[0] if t else features("", "a")[0] for t in texts]
    assert features(*texts) == alone
