"""Byte-pair encoding with word ends, merged for many words at once.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary
search over the sorted pair keys, takes each word's lowest rank, merges that pair wherever it stands
in the word, left to right, and compacts the array; words without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The white space the tokenizer's normaliser knows, and its word pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
WORD_OR_END = regex.compile(f"{WORD.pattern}|\x20")
CHUNK = regex.compile(f"[^{WHITE}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")

CACHE_CHUNKS = 1_000_000
MISSING_AT_ONCE = 20_000
SLICE_CHARS = 1_000_000
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordBpe:
    """An encoder and decoder for one tokenizer file; create it on the worker that uses it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = np.full(size, None, dtype=object)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        self.token_bytes = np.array([None if t is None else t.encode("utf-8") for t in self.tokens], dtype=object)
        # By chunk; values are plain bytes, which the garbage collector need not visit.
        self.ids_of: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the bounds of each word's ids. No word is empty."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.cumsum(length) - 1
        symbols = self.inner[data]
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), length)
        done_symbols, done_owner = [], []
        rank = self._ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(symbols)])
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            over = best == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                symbols, owner, rank, best = symbols[~over], owner[~over], rank[~over], best[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(_every_other(rank == best))
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the merged symbols stand once the array is compact
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.r_[new, new[new > 0] - 1]
            rank[changed] = self._ranks(symbols, owner, changed)
        if not done_symbols:  # no words
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given places."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << 20 | symbols[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[found] == key) & (owner[at] == owner[after]) & (after > at)
        return np.where(known, self.rank[found], NO_RANK)

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks (text without white space) into the cache."""
        new = chunks.difference(self.ids_of)
        marked = [c for c in new if "<|" in c]
        if marked:
            parts = {c: [x for x in self.special_pattern.split(c) if x] for c in marked}
            self.learn_plain({x for own in parts.values() for x in own if x not in self.special and x not in self.ids_of})
            for c, own in parts.items():
                self.ids_of[c] = b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.ids_of[x] for x in own)
            new.difference_update(marked)
        self.learn_plain(new)

    def learn_plain(self, chunks: Iterable[str]) -> None:
        """As learn, for chunks without special tokens; many at once."""
        chunks = list(chunks)
        for i in range(0, len(chunks), MISSING_AT_ONCE):
            part = chunks[i : i + MISSING_AT_ONCE]
            # Neither normalisation nor words reach across a space, so that one text holds all chunks.
            found = WORD_OR_END.findall(normalise(" ".join(part) + " "))
            ends = np.flatnonzero(np.array(found, dtype=object) == " ")
            words = list(filter(" ".__ne__, found))
            ids, bounds = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
            flat, cut = ids.astype("<u4").tobytes(), [0, *(4 * bounds[ends - np.arange(len(ends))]).tolist()]
            self.ids_of.update(zip(part, map(flat.__getitem__, map(slice, cut, cut[1:])), strict=True))

    def forget(self) -> None:
        """Give the cache back; partitions have few chunks in common, and the worker outlives them."""
        self.ids_of = {}

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, special tokens included, in UTF-8; the file names no decoder."""
        return b" ".join(self.token_bytes[ids].tolist())

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for part in slices(texts):
            chunks = [chunks_of(t) for t in part]
            if len(self.ids_of) > CACHE_CHUNKS:
                self.ids_of.clear()
            self.learn(set().union(*chunks))
            for own in chunks:
                yield b"".join(map(self.ids_of.__getitem__, own))


def normalise(text: str) -> str:
    """Composed form, then lower case character by character (a final sigma stays a plain one)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def chunks_of(text: str | None) -> list[str]:
    if not text:
        return []
    return text.split() if not SEPARATORS.search(text) else CHUNK.findall(text)


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about SLICE_CHARS characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of hits the first, third, ...: overlapping pairs of a repeated symbol."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    n = np.arange(len(hit))
    run_start = np.where(hit & ~np.r_[False, hit[:-1]], n, 0)
    return hit & ((n - np.maximum.accumulate(run_start)) % 2 == 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


@contextmanager
def borrowed(path: str) -> Iterator[WordBpe]:
    """The worker's encoder, whose cache is given back in the end."""
    bpe = encoder(path)
    try:
        yield bpe
    finally:
        bpe.forget()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text; one row of digests for each input row, in any order.

    Null and empty texts have no ids and decode to "". Repeated rows give repeated results, a null
    key stays null, other columns are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(path) as bpe:
            for batch in batches:
                count, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_texts(batch.column(1).to_pylist()):
                    count.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The token ids of every text: (key, ids array<int>); null and empty texts have an empty array."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(path) as bpe:
            for batch in batches:
                got = [np.frombuffer(ids, dtype="<i4") for ids in bpe.encode_texts(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The text of every id array: (key, text); a null array decodes to ""."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            got = [bpe.decode(np.array(x, dtype=np.int64)).decode("utf-8") if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} long, text string")
