"""Packing of token sequences into windows of a fixed capacity by multiway differencing.

Each document's ids are cut: full windows first, each a sequence of its own, then pieces of at most
``piece`` ids. Pieces gather in groups that hold a whole number of windows less a small slack. Within
a group the Karmarkar-Karp method keeps partial partitions (k sums each) in a heap by imbalance and
merges the two most unbalanced, largest sums against smallest; the k near-equal sums are the
windows. If a sum exceeds the capacity, k rises by one and the group is done again. At the end of a
partition all that fills windows is packed the same way, in finer pieces; the tail that is left, less
than a window, is cut to lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barlake.llm import bpe

CAPACITY = 4096
END_ID = 2

Piece = tuple[int, int, int]  # document number, start, length


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k sets with near-equal sums; returns the item numbers of each set.

    No sizes gives k empty sets; equal sizes are taken in the given order.
    """
    zero = np.zeros(k, dtype=np.int64)
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes):
        sums = zero.copy()
        sums[0] = size
        heap.append((-size, i, sums, [[i], *([] for _ in range(k - 1))]))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)  # sums fall, the last is 0
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sets = [in_a[j] + in_b[k - 1 - j] for j in order.tolist()]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), n, sums, sets))
        n += 1
    return heap[0][3]


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the least possible count up, whose sums all fit the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, k)
        if all(sum(sizes[i] for i in own) <= capacity for own in sets):
            return sets
        k += 1


def fit(sets: list[list[int]], pieces: list[Piece], capacity: int) -> bool:
    return all(sum(pieces[i][2] for i in own) <= capacity for own in sets)


def finer(pieces: list[Piece], most: int) -> Iterator[Piece]:
    """The pieces in parts of at most ``most`` ids."""
    for doc, start, length in pieces:
        for at in range(0, length, most):
            yield doc, start + at, min(most, length - at)


def joined(pieces: list[Piece]) -> list[Piece]:
    """Pieces by document and place, those that follow one another as one."""
    out: list[Piece] = []
    for doc, start, length in sorted(pieces):
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = doc, out[-1][1], out[-1][2] + length
        else:
            out.append((doc, start, length))
    return out


class Packer:
    """Packs the documents of one partition; memory holds one group of windows."""

    def __init__(self, first_sequence: int, capacity: int, piece: int, windows: int, slack: int):
        self.sequence, self.capacity, self.piece = first_sequence, capacity, piece
        self.slack, self.room = slack, windows * (capacity - slack)
        self.pieces: list[Piece] = []
        self.size = 0

    def add(self, doc: int, length: int) -> Iterator[tuple[Piece, int, int]]:
        """Take a document's ids; yields (piece, sequence, offset) for what is placed by now."""
        start = 0
        while length - start >= self.capacity:
            yield (doc, start, self.capacity), self.sequence, 0
            self.sequence += 1
            start += self.capacity
        while start < length:
            take = min(self.piece, length - start, self.room - self.size)
            self.pieces.append((doc, start, take))
            self.size += take
            start += take
            if self.size == self.room:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[Piece, int, int]]:
        """Place the gathered pieces in near-equal windows."""
        for own in near_equal_windows([p[2] for p in self.pieces], self.capacity):
            yield from self._place([self.pieces[i] for i in own])
        self.pieces, self.size = [], 0

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        """Place the rest: near-equal windows of all that fills them, then the tail in sequences of a power of two.

        Few pieces are seldom near-equal: where their sums exceed the capacity they are cut to an eighth first,
        and where those sums do, the count rises. The tail is less than a window and gives twelve short
        sequences at most.
        """
        full = self.capacity - self.slack
        k = self.size // full
        tail = self._cut_off(self.size - k * full)
        if k:
            pieces = self.pieces
            sets = difference([p[2] for p in pieces], k)
            if not fit(sets, pieces, self.capacity):
                pieces = list(finer(pieces, max(1, self.piece // 8)))
                sets = near_equal_windows([p[2] for p in pieces], self.capacity)
            for own in sets:
                yield from self._place(joined([pieces[i] for i in own]))
        total = sum(p[2] for p in tail)
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                own, need = [], 1 << bit
                while need:
                    doc, start, length = tail.pop(0)
                    take = min(need, length)
                    own.append((doc, start, take))
                    if take < length:
                        tail.insert(0, (doc, start + take, length - take))
                    need -= take
                yield from self._place(own)
        self.pieces, self.size = [], 0

    def _cut_off(self, left: int) -> list[Piece]:
        """The last ``left`` ids of what is gathered."""
        tail: list[Piece] = []
        while left:
            doc, start, length = self.pieces.pop()
            take = min(left, length)
            tail.append((doc, start + length - take, take))
            if take < length:
                self.pieces.append((doc, start, length - take))
            left -= take
        tail.reverse()
        return tail

    def _place(self, own: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in own:
            yield p, self.sequence, offset
            offset += p[2]
        self.sequence += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    piece: int = 1024,
    windows: int = 64,
    slack: int = 8,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
    keep_cache: bool = False,
) -> DataFrame:
    """Pack every document's ids and an end id into sequences; one row for each piece.

    Null and empty texts have the end id alone, repeated rows are packed each, an empty table gives
    no rows; other columns are not read. ``with_ids`` adds the piece's ids. ``keep_cache`` lets a
    worker keep its encoder's cache for the next partition, some 150 MB, which is for sessions that go on
    to no other stage. Sequence numbers are unique over the result; each partition packs its own documents, so nothing is shuffled.
    """
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        end = end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, piece, windows, slack)
        waiting: dict[int, tuple[int | None, bytes]] = {}
        number = 0

        def rows(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
            ids = [waiting[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p, _, _ in placed]
            columns = [
                pa.array([waiting[p[0]][0] for p, _, _ in placed], pa.int64()),
                pa.array([p[1] for p, _, _ in placed], pa.int64()),
                pa.array([p[2] for p, _, _ in placed], pa.int64()),
                pa.array(map(zlib.crc32, ids), pa.int64()),
                pa.array([len(waiting[p[0]][1]) // 4 for p, _, _ in placed], pa.int64()),
                pa.array([s for _, s, _ in placed], pa.int64()),
                pa.array([o for _, _, o in placed], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        placed: list[tuple[Piece, int, int]] = []
        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).to_pylist()
            for doc, ids in zip(keys, coder.encode_texts(batch.column(1).to_pylist()), strict=True):
                waiting[number] = doc, ids + end
                placed += packer.add(number, len(ids) // 4 + 1)
                number += 1
                if len(placed) >= 2000:
                    yield rows(placed)
                    placed = []
                    needed = {p[0] for p in packer.pieces}
                    waiting = {k: v for k, v in waiting.items() if k in needed}
        if not keep_cache:
            coder.forget()
        placed += packer.finish()
        if placed:
            yield rows(placed)

    schema = SCHEMA.replace("doc_id", key, 1) + (", ids array<int>" if with_ids else "")
    out = docs.select(key, text).mapInArrow(run, schema.replace(key, "doc_id", 1))
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
