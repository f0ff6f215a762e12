"""Counting of byte tokens inside tasks: one row per group and token leaves a task, however often it stands there."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from glotweave.llm.batches import PIECE_BYTES, pieces

#: (group, token) pairs that a task holds before it passes its counts on.
HELD = 400_000


def byte_table(change: Callable[[int], int]) -> bytes:
    """A table for ``bytes.translate`` from a rule for ASCII; the bytes of other characters stay."""
    return bytes(change(b) if b < 128 else b for b in range(256))


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts (null: empty) with their bytes mapped by ``table``."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n, raw = len(texts), texts.buffers()[2]
    if raw is None or not n:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(table, np.uint8)[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])


def count_tokens(table: bytes, groups: list[str], text: str, with_docs: bool, token: str = "term"):
    """A function for ``mapInArrow``: (groups, token, n), and d, in how many rows the token stands, if asked for.

    ``table`` maps all that separates tokens to white space.  A task's counts of one (group, token) may come in several rows.
    """
    names = [*groups, token, "n", *(["d"] if with_docs else [])]

    def out(held: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for key, counts in held.items():
            if not counts:
                continue
            tokens = list(counts)
            columns = [pa.array([k] * len(tokens), pa.string()) for k in key]
            columns += [pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())]
            if with_docs:
                columns.append(pa.array([docs[key][t] for t in tokens], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        for batch in batches:
            for part in pieces(batch, text, max_bytes=4 * PIECE_BYTES):
                keys = list(zip(*[part.column(g).to_pylist() for g in groups]))
                for key, data in zip(keys, translated(part.column(text), table).to_pylist()):
                    counts = held.setdefault(key, Counter())
                    tokens = data.split()
                    counts.update(tokens)
                    if with_docs:
                        docs.setdefault(key, Counter()).update(set(tokens))
                if sum(map(len, held.values())) > HELD:
                    yield from out(held, docs)
                    held, docs = {}, {}
        yield from out(held, docs)

    return run
