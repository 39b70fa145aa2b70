"""Removal of passages that repeat across documents, exact on windows of consecutive words.

A window of ``window`` words is folded onto its anchor, the smallest hash among the shorter grams
inside it: equal windows have equal anchors, and neighbouring windows mostly share one, so the
anchors of a text number far fewer than its windows. Count-min sketches count the documents of each
anchor: every partition counts its own cells, the partial sketches of a hash shard are added, and
the smallest cell of an anchor is never below the number of documents that hold the window. Windows
whose estimate is one cannot repeat; a second pass groups exactly, by two 64-bit hashes, only the
windows estimated repeated. Nothing is sampled or capped, so no repeated window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm import textops
from barlake.llm.storage import durable, shards

WINDOW = 50
BLOCK_BYTES = 4_000_000
ANCHORS_AT_ONCE = 2_000_000
SKETCH_ROWS = 2
CELLS_PER_ANCHOR = 8
MAX_WIDTH = 1 << 20
ENTRIES_PER_SHARD = 1_000_000


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each start the anchor of the window there (also across rows; callers pick valid starts)."""
    gram = max(1, window // 3)
    return textops.mix(textops.sliding_min(textops.gram_hashes(hashes, gram), window - gram + 1))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """Distinct (doc_id, key) pairs of every document's window anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for words in textops.split_words(batch.column(1)):
                at = words.windows(window)
                if not len(at):
                    continue
                row = words.row_of_word()[at]
                key = window_anchors(textops.word_hashes(words), window)[at]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
                row, key = row[new], key[new]
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[words.first + row[new]]), pa.array(key[new].view(np.int64))], names=["doc_id", "key"]
                )

    return docs.mapInArrow(run, "doc_id long, key long")


def _in_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The first column as unsigned keys, about ``most`` at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        size += len(held[-1])
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _shard(key: np.ndarray, count: int) -> np.ndarray:
    return ((key >> np.uint64(44)) % np.uint64(count)).astype(np.int64)


def _cells(key: np.ndarray, width: int) -> list[np.ndarray]:
    """A key's cell in each row of its shard's sketch."""
    mask = np.uint64(width - 1)
    other = textops.mix(key)
    return [(r * width + (k & mask).astype(np.int64)) for r, k in enumerate((key, other))]


def sketch(keys: DataFrame, count: int, width: int) -> DataFrame:
    """Merged count-min sketches: (shard, bits), a bit for each cell that counted two or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in _in_batches(batches, ANCHORS_AT_ONCE):
            shard = _shard(key, count) * (SKETCH_ROWS * width)
            cells, times = np.unique(np.concatenate([shard + c for c in _cells(key, width)]), return_counts=True)
            owner = cells // (SKETCH_ROWS * width)
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
            own = (cells % (SKETCH_ROWS * width)).astype("<u4")
            few = np.minimum(times, 2).astype(np.uint8)
            pairs = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[cut[:-1]], pa.int64()),
                    pa.array([own[a:b].tobytes() for a, b in pairs], pa.binary()),
                    pa.array([few[a:b].tobytes() for a, b in pairs], pa.binary()),
                ],
                names=["shard", "cells", "times"],
            )

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROWS * width, dtype=np.uint8)
        for cells, times in zip(table.column("cells").to_pylist(), table.column("times").to_pylist(), strict=True):
            at = np.frombuffer(cells, dtype="<u4")  # distinct within a partial sketch
            total[at] = np.minimum(total[at] + np.frombuffer(times, dtype=np.uint8), 2)
        return pa.table({"shard": table.column("shard").slice(0, 1), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    # As many partitions as shards, here and below, so that no task's share grows with the corpus.
    partials = keys.mapInArrow(partial, "shard long, cells binary, times binary").repartition(count, "shard")
    return partials.groupBy("shard").applyInArrow(merge, "shard long, bits binary")


def estimated_repeated(keys: DataFrame, sketches: DataFrame, count: int, width: int) -> DataFrame:
    """Distinct keys whose estimated count is two or more."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in _in_batches(batches, ANCHORS_AT_ONCE):
            key = np.unique(key)
            shard = _shard(key, count)
            order = np.argsort(shard, kind="stable")
            key, shard = key[order], shard[order]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            blobs = [key[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "keys"])

    def keep(probe: pa.Table, merged: pa.Table) -> pa.Table:
        out = np.zeros(0, np.uint64)
        if probe.num_rows and merged.num_rows:
            bits = np.unpackbits(np.frombuffer(merged.column("bits")[0].as_py(), dtype=np.uint8)).view(bool)
            key = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in probe.column("keys").to_pylist()]))
            out = key[np.logical_and.reduce([bits[c] for c in _cells(key, width)])]
        return pa.table({"key": pa.array(out.view(np.int64))})

    probe = keys.mapInArrow(probes, "shard long, keys binary").repartition(count, "shard")
    return probe.groupBy("shard").cogroup(sketches.repartition(count, "shard").groupBy("shard")).applyInArrow(keep, "key long")


def _pack_block(rows: list[dict], carry: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("keys", pa.list_(pa.int64())), ("carry", carry)])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Block:
    """A block's documents and its windows estimated repeated, grouped by hash shard."""

    def __init__(self, payload: bytes, window: int, count: int):
        self.table = pa.ipc.open_stream(payload).read_all()
        ids = self.table.column("doc_id").to_numpy()
        keys = self.table.column("keys").combine_chunks()
        values, at = keys.values.to_numpy(zero_copy_only=False).view(np.uint64), keys.offsets.to_numpy()
        rows, starts, h1, h2 = [], [], [], []
        for words in textops.split_words(self.table.column("text")):
            valid = words.windows(window)
            if not len(valid):
                continue
            row = words.row_of_word()[valid]
            hashes = textops.word_hashes(words)
            anchor = window_anchors(hashes, window)[valid]
            wanted = np.zeros(len(valid), dtype=bool)
            bounds = np.searchsorted(row, np.arange(words.rows + 1))
            for r in range(words.rows):
                a, b = bounds[r], bounds[r + 1]
                own = values[at[words.first + r] : at[words.first + r + 1]]
                if b > a:
                    wanted[a:b] = np.isin(anchor[a:b], own)
            valid, row = valid[wanted], row[wanted]
            rows.append(words.first + row)
            starts.append(valid - words.bounds[row])
            h1.append(textops.gram_hashes(hashes, window, 1)[valid])
            h2.append(textops.gram_hashes(textops.word_hashes(words, seed=77), window, 2)[valid])
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if rows else np.zeros(0, np.int64)
        a = np.concatenate(h1) if rows else np.zeros(0, np.uint64)
        b = np.concatenate(h2) if rows else np.zeros(0, np.uint64)
        self.doc = ids[self.row]
        shard = _shard(a, count)
        # Distinct windows in the order of (shard, hashes), each with the block's smallest document.
        order = np.lexsort((self.doc, b, a, shard))
        a, b, shard, doc = a[order], b[order], shard[order], self.doc[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        self.entry = np.empty(len(a), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.h1, self.h2, self.shard, self.least = a[new], b[new], shard[new], doc[new]


def block_entries(blocks: DataFrame, window: int, count: int) -> DataFrame:
    """For each block and shard the block's distinct candidate windows and their smallest documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _Block(payload.as_py(), window, count)
                cut = np.flatnonzero(np.r_[True, x.shard[1:] != x.shard[:-1], True]) if len(x.shard) else np.zeros(1, np.int64)
                pairs = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.shard[cut[:-1]], pa.int64()),
                        pa.array([number] * len(pairs), pa.int64()),
                        *(pa.array([v[a:b].tobytes() for a, b in pairs], pa.binary()) for v in (x.h1, x.h2, x.least)),
                    ],
                    names=["shard", "block", "h1", "h2", "least"],
                )

    return blocks.select("block", "payload").mapInArrow(run, "shard long, block long, h1 binary, h2 binary, least binary")


def _earlier(table: pa.Table) -> pa.Table:
    """For each block's windows of a shard one bit: a smaller document elsewhere has the window."""
    parts = {n: [np.frombuffer(x, dtype=np.uint64 if n != "least" else np.int64) for x in table.column(n).to_pylist()] for n in ("h1", "h2", "least")}
    a, b, doc = (np.concatenate(parts[n]) for n in ("h1", "h2", "least"))
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    bit = np.empty(len(a), dtype=bool)
    bit[order] = doc[first] < doc
    cut = np.r_[0, np.cumsum([len(x) for x in parts["h1"]])]
    bits = [np.packbits(bit[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 for each input row; ``with_text`` adds the kept
    text (unchanged where nothing was removed, else the kept words joined by a space) and the
    documents' other columns, which win where they are named like a figure: that figure is then left
    out. Windows are judged on the input.

    Null and empty texts have no words. A null doc_id is no smaller than any and takes no part: its
    row stays whole. Rows that repeat a doc_id are one document in comparisons and one row each in
    the result. Of other columns none is read.
    """
    spark = docs.sparkSession
    other = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")] if with_text else []
    carry = F.struct(*[F.col(f"`{f.name}`") for f in other]) if other else F.lit(None).cast("struct<none:int>")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), carry.alias("carry"))

    pairs = durable(anchors(docs.filter("doc_id is not null").select("doc_id", "text"), window), "anchors")
    n = pairs.count()
    count = shards(spark, n * CELLS_PER_ANCHOR, MAX_WIDTH)
    width = min(MAX_WIDTH, 1 << max(10, (n * CELLS_PER_ANCHOR // count).bit_length()))
    keys = pairs.select("key")
    suspects = estimated_repeated(keys, sketch(keys, count, width), count, width)
    doc_keys = pairs.join(suspects, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    staged = durable(_stage(docs.join(doc_keys, "doc_id", "left"), window, with_text), "staged")

    blocks = staged.filter("block is not null").select("block", "payload", "entries")
    entries = blocks.agg(F.sum("entries")).first()[0] or 0
    final = shards(spark, entries, ENTRIES_PER_SHARD)
    verdicts = block_entries(blocks, window, final).repartition(final, "shard").groupBy("shard").applyInArrow(_earlier, "block long, shard long, bits binary")
    schema = T.StructType([f for f in staged.schema.fields if f.name not in ("block", "payload", "entries")])
    dealt = blocks.select("block", "payload").repartition(final, "block").groupBy("block").cogroup(verdicts.repartition(final, "block").groupBy("block"))
    done = dealt.applyInArrow(_settle(window, final, with_text), schema)
    result = staged.filter("block is null").select(*schema.names).unionByName(done)
    if not with_text:
        return result.drop("text", "carry")
    taken = {f.name.lower() for f in other}
    return result.select("doc_id", "text", *[F.col(f"carry.`{f.name}`").alias(f.name) for f in other], *[c for c in ("n_words", "n_removed", "kept_sha256") if c not in taken])


def _stage(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Finish documents without suspected windows; put the others into numbered blocks."""
    carry = docs.schema["carry"].dataType
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("text", "string").add("carry", carry).add("block", "long").add("payload", "binary").add("entries", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        size = 0
        kind = None

        def block() -> pa.RecordBatch:
            entries = sum(max(0, len(r["text"].encode().split()) - window + 1) for r in held)
            return _rows([], [(number, _pack_block(held, kind), entries)], kind)

        for batch in batches:
            kind = batch.schema.field("carry").type
            clean = []
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "carry", "keys"))
            for doc, text, extra, keys in zip(*columns, strict=True):
                text = text.as_py()
                if not keys.is_valid:
                    words = (text or "").encode().split()
                    clean.append((doc.as_py(), len(words), 0, _digest(words), text if with_text else None, extra.as_py()))
                    continue
                held.append({"doc_id": doc.as_py(), "text": text, "keys": keys.as_py(), "carry": extra.as_py()})
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, number = [], 0, number + 1
            yield _rows(clean, [], kind)
        if held:
            yield block()

    return docs.select("doc_id", "text", "carry", "keys").mapInArrow(run, schema)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _rows(done: list[tuple], blocks: list[tuple], carry: pa.DataType) -> pa.RecordBatch:
    n, m = len(done), len(blocks)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), carry)
    columns = [pa.array([*(r[i] for r in done), *[None] * m], kind) for i, kind in enumerate(types)]
    columns += [pa.array([*[None] * n, *(b[i] for b in blocks)], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "carry", "block", "payload", "entries"])


def _settle(window: int, count: int, with_text: bool):
    def run(blocks: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = []
        verdict = {s: b for s, b in zip(verdicts.column("shard").to_pylist(), verdicts.column("bits").to_pylist(), strict=True)}
        kind = None
        for payload in blocks.column("payload").to_pylist():
            x = _Block(payload, window, count)
            sizes = np.bincount(x.shard, minlength=count) if len(x.shard) else []
            bit = [np.unpackbits(np.frombuffer(verdict[s], dtype=np.uint8))[: sizes[s]] for s in np.flatnonzero(sizes)]
            earlier = np.concatenate(bit).view(bool) if bit else np.zeros(0, bool)
            gone = earlier[x.entry] | (x.doc > x.least[x.entry])
            row, start = x.row[gone], x.start[gone]
            bounds = np.searchsorted(row, np.arange(x.table.num_rows + 1))
            kind = x.table.schema.field("carry").type
            docs = (x.table.column(c) for c in ("doc_id", "text", "carry"))
            for i, (doc, text, extra) in enumerate(zip(*docs, strict=True)):
                text = text.as_py()
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                own = start[bounds[i] : bounds[i + 1]]
                np.add.at(edge, own, 1)
                np.add.at(edge, own + window, -1)
                kept = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                if with_text and len(kept) < len(words):
                    text = b" ".join(kept).decode()
                out.append((doc.as_py(), len(words), len(words) - len(kept), _digest(kept), text if with_text else None, extra.as_py()))
        batch = _rows(out, [], kind)
        return pa.Table.from_batches([batch]).select(["doc_id", "n_words", "n_removed", "kept_sha256", "text", "carry"])

    return run
