import hashlib
import random
import zlib

import pytest

from barlake.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string"


def sha(s):
    return hashlib.sha256(s.encode()).digest()


def brute_force(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:] if base != c else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(key)))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(100, 130), 201, 202, 350, -100, -7, -101, *range(300, 312)]:
        kind = rng.choice(["copy", "own", "own", "common"])
        for t in range(rng.randint(1, 9)):
            text = {"copy": f"c{t}", "own": rng.choice(["é" * 5, "a", "b", None, ""]), "common": "hello" if t == 0 else f"x{rng.randint(0, 1)}"}[kind]
            rows.append((c, rng.choice([t, t, t, None]) if kind == "own" else t, rng.choice(["user", None]) if kind == "own" else "user", text, "k", "n"))
    rows += [rows[3]] * 4 + [(None, 1, "user", "lost", "k", "n")] + [(5_000, t, "user", f"t{t}", "k", "n") for t in range(300)] + [(c, t, "user", f"t{t}", "k", "n") for c in (5_001, 5_100, 5_101) for t in range(280 if c > 5_001 else 250)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = conversations(seed)
    out = prefixes.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == prefixes.NODE
    assert got(out) == brute_force(rows)


def test_blocks_of_ends_join_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "ENDS_BLOCK", 7)
    rows = [(c, 0, "user", "same", "k", "n") for c in range(-60, 250)]
    assert got(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_framing_keeps_role_and_text_apart(spark):
    rows = [(100, 0, "ab", "c", "k", "n"), (200, 0, "a", "bc", "k", "n"), (300, 0, "", "abc", "k", "n"), (400, 0, None, "abc", "k", "n")]
    assert got(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_turnless_conversations_and_long_texts(spark):
    rows = [(c, 0, "user", "x", "k", "n") for c in range(1, 9)] + [(700, 0, "user", "y" * 3_000_000, "k", "n"), (701, 0, "user", "z", "k", "n")]
    want = brute_force(rows)
    assert any(r[1] == 0 and r[7] != prefixes.EMPTY for r in want)
    assert got(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == want


def test_no_more_rows_than_turns(spark):
    """Conversations that are each other's beginnings: sums go to runs, not to every pair of node and ancestor."""
    rows = [(c * 100, t, "user", f"t{t}", "k", "n") for c in range(12) for t in range(10 * (c + 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixes.trie(df)) == brute_force(rows)
    paths = prefixes.prefixes(prefixes.rebuilt(prefixes.numbered(df)))
    assert prefixes.walked(prefixes.placed(paths)).filter("kind = 1").count() <= len(rows) / 10


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x", "k", "n")]])
def test_no_conversation_no_node(spark, rows):
    assert prefixes.trie(spark.createDataFrame(rows, SCHEMA)).collect() == []
