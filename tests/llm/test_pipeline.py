import random

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from barlake.llm import bpe, pii, quality
from tests.llm.test_bpe_packing import check_packing
from tests.llm.test_neardup import brute_force as near_groups
from tests.llm.test_substring import brute_force as repeats


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(80)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 120)))
        if i % 10 == 0:
            text = " ".join(f"$${rng.randrange(10**6)}!!" for _ in range(60))
        elif i % 7 == 1:
            text += " mail a.b@mail.com and 1.2.3.4"
        elif i % 9 == 2:
            text += " " + passage + " end"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200, rows[5][1], "en", "s", 1), (201, rows[5][1] + " more", "en", "s", 1), (202, None, None, None, None), (203, "", "fr", "s", 0), (None, rows[5][1], "en", "s", 1)]
    # The last columns are named like figures of the operators.
    rows = [(*r, f"own {r[0]}", f"mine {r[0]}", True) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_sha256 string, keep boolean")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 10 != 0), 0) for i in range(120) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    key = lambda rows: sorted(rows, key=str)

    kept = corpus_pipeline.keep_quality(spark, docs, tables)
    assert kept.columns == columns
    verdict = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    rows = [tuple(r) for r in docs.collect()]
    want = [r for r in rows if r[0] is None or verdict[r[0]]]
    assert key(map(tuple, kept.collect())) == key(want)
    assert not any(r[0] is not None and r[0] < 120 and r[0] % 10 == 0 for r in want) and len(want) >= 110

    one = corpus_pipeline.drop_near_duplicates(spark, kept, tables)
    gone = {i for i, _, _, stays in near_groups([r[:2] for r in want], 80) if not stays}
    want = [r for r in want if r[0] not in gone]
    assert one.columns == columns and gone >= {200, 201} and key(map(tuple, one.collect())) == key(want)

    cut = corpus_pipeline.remove_repeated_passages(spark, one, tables)
    texts = {r.doc_id: r for r in cut.collect()}
    by_words = repeats([r[:2] for r in want], 50)
    assert cut.columns == columns and len(texts) == len(want)
    for doc, n, n_removed, _ in by_words:
        assert len((texts[doc].text or "").split()) == n - n_removed and texts[doc].n_chars == (None if texts[doc].text is None else len(texts[doc].text))
    assert sum(x[2] > 0 for x in by_words) > 3
    assert all((r.n_words, r.kept_sha256, r.keep) == (f"own {doc}", f"mine {doc}", True) for doc, r in texts.items())

    masked = {r.doc_id: r for r in corpus_pipeline.mask_personal_data(spark, cut, tables).collect()}
    assert set(masked) == set(texts) and all(r.n_words == f"own {doc}" for doc, r in masked.items())
    for doc, r in masked.items():
        for s in pii.base_spans(texts[doc].text or ""):
            assert texts[doc].text[s.start : s.end] not in r.text
    assert any("<EMAIL> and <IP>" in (r.text or "") for r in masked.values())

    library = Tokenizer.from_file(bpe.default_path())
    ids = {doc: library.encode(r.text or "", add_special_tokens=False).ids for doc, r in masked.items()}
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert check_packing(pieces, ids, 4096) < 0.03
