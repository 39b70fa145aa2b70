"""Texts and sorted arrays in packed rows, for joins of n-grams with hash shards.

Documents of a partition form blocks. Arrays travel as compressed byte planes, a row for each block
and shard, so that an n-gram costs a few bytes and no row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from barlake.llm import textops

BLOCK_BYTES = 3_000_000


def text_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """(block, payload): the documents of one partition in compressed runs of about ``block_bytes``."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_table(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    for batch in batches:
        _, at = textops.text_buffers(batch.column(1))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes - size, side="right")) - 1)
            held.append(batch.slice(i, j - i))
            size += int(at[j] - at[i])
            i = j
            if size >= block_bytes or i < len(batch):
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


def chunks(column: pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for chunk in column.chunks:
        yield at, chunk
        at += len(chunk)


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed; the high planes of small values nearly vanish."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def expand(blob: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = pa.decompress(blob, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()
