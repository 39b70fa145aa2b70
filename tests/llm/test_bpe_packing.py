import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from barlake.llm import bpe, packing

POOL = "aaabcdé'sSΣİß $\x1c\x85 ́字かー１２½９<|endoftext|>ſKÅẞ!#\n\t😀x'll're"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return odd + ["<|endoftext|>a<|startoftext|><|x", "a" * 5000, "ab" * 2000 + "#" * 3000, "", "same", "same", "<|ENDOFTEXT|>", "hello world. " * 3000]


def frame(spark, rows):
    """Documents with an extra column whose name clashes with an output."""
    schema = "doc_id long, text string, n_tokens string, length string"
    return spark.createDataFrame([(*r, "x", None) for r in rows], schema)


def test_encoding_equals_library(library, texts):
    coder = bpe.WordBpe(bpe.default_path())
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False)
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == want.ids
        assert coder.decode(got).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_cache_reset_keeps_results(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    coder = bpe.WordBpe(bpe.default_path())
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null key"), (7, None), (7, None)]
    got = bpe.digests(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (7, None)}
    for i, t in enumerate(texts):
        if i != 7:
            want = library.encode(t, add_special_tokens=False).ids
            assert by[i].n_tokens == len(want)
            assert by[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert by[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert sum(r.doc_id == 7 and r.n_tokens == 0 for r in got) >= 2
    assert bpe.digests(frame(spark, [])).collect() == []


def test_decode_of_encode(spark, library):
    rows = [(1, "Some TEXT, here."), (2, None)]
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, rows))).collect()}
    assert got == {1: library.decode(library.encode("Some TEXT, here.").ids), 2: ""}


def check_packing(pieces, want_ids, capacity):
    """Every id lies in one piece; sequences are gapless and fit; returns the share of padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(docs) == set(want_ids)
    for k, own in docs.items():
        ids = np.array([*want_ids[k], packing.END_ID], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding / sum(p.length for p in pieces)


def test_pack(spark, library, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None)]
    pieces = packing.pack(frame(spark, rows)).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert check_packing(pieces, want, 4096) < 0.03
    assert packing.pack(frame(spark, [])).collect() == []


def test_pack_repeated_and_null_keys(spark):
    pieces = packing.pack(frame(spark, [(3, "a b"), (3, "a b"), (None, "c")])).collect()
    assert sum(p.length for p in pieces if p.doc_id == 3) == 3 + 3
    assert sum(p.length for p in pieces if p.doc_id is None) == 2


def test_windows_rise_when_capacity_is_exceeded():
    sets = packing.near_equal_windows([60, 60, 60, 20], 100)  # 200 ids need two windows by sum, but three items exceed a half
    assert len(sets) == 3
    assert sorted(i for s in sets for i in s) == [0, 1, 2, 3]


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(400)]
    sums = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 50)]
    assert max(sums) - min(sums) <= 60
    assert packing.difference([], 3) == [[], [], []]
    assert sorted(sum([5, 5, 5, 5][i] for i in s) for s in packing.difference([5, 5, 5, 5], 2)) == [10, 10]


@pytest.mark.parametrize("seed,count,longest", [(1, 3, 9000), (2, 40, 3000), (3, 400, 900), (4, 1, 40_000), (5, 2000, 5), (6, 1, 3)])
def test_the_end_of_a_partition_is_packed_by_differencing(seed, count, longest):
    """Whole windows come from near-equal sums; only a tail shorter than a window is cut to powers of two."""
    rng = random.Random(seed)
    packer = packing.Packer(0, 4096, 1024, 64, 8)
    lengths = [rng.randint(1, longest) for _ in range(count)]
    placed = [x for i, n in enumerate(lengths) for x in packer.add(i, n)] + list(packer.finish())
    fill = Counter()
    for (_, _, length), sequence, offset in placed:
        assert offset == fill[sequence]
        fill[sequence] += length
    ids = sorted((doc, start, length) for (doc, start, length), _, _ in placed)
    assert [sum(p[2] for p in ids if p[0] == i) for i in range(count)] == lengths
    assert all(a[1] + a[2] == b[1] for a, b in zip(ids, ids[1:], strict=False) if a[0] == b[0])
    short = [n for n in fill.values() if n < 4096 - 8 - 1024]
    assert len(short) <= 12 and all(n & (n - 1) == 0 for n in short) and sum(short) < 4096
    assert sum(4096 - n for n in fill.values() if n & (n - 1)) <= 0.02 * sum(lengths) + 4096
