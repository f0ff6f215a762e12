"""Arrow batches cut into pieces of bounded text and rows, so that a task's memory follows the piece and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, text: str = "text", max_bytes: int = PIECE_BYTES, max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of consecutive rows, ``max_rows`` at most, whose texts have at most ``max_bytes``; a longer text is alone
    in its piece."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.zeros(n, dtype=np.int64)
    column = batch.column(text)
    sizes[:] = np.asarray(pa.compute.binary_length(column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column).fill_null(0))
    ahead = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ahead[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ahead, base + max_bytes, "right")))
        stop = stop if max_rows is None else min(stop, start + max_rows)
        yield batch.slice(start, stop - start)
        start = stop


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's long."""
    return pa.array(x.view(np.int64))
