"""Vectorised access to the texts of Arrow batches: pieces, words and classes of bytes.

The helpers work on slices of bounded size, so memory does not grow with a batch. A text longer than
the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SLICE_BYTES = 4 << 20

# The package's code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# The ASCII white space of the word patterns, \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks."""
    holder = sys.modules.setdefault("_tidecast_worker_cache", types.ModuleType("_tidecast_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def give_back_memory() -> None:
    """Return freed memory to the system: a worker waits for its next task without holding it."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most `limit` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back_memory()


@dataclass
class Texts:
    """Bytes of several texts laid end to end; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per byte."""
        sums = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def texts_of(column: pa.Array) -> Texts:
    """The texts of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    if data is None or first == last:
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64))
    return Texts(np.frombuffer(data, dtype=np.uint8)[first:last], offsets - first)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Pieces data[offsets[i]:offsets[i + 1]] as an Arrow array, without a copy of the bytes."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )


@dataclass
class Pieces:
    """The texts cut before every run of white space: each piece is optional space, then a word.

    `ids` and `doc` have one entry for each piece in text order, `distinct` one for each different piece.
    Joined together the pieces give the texts back.
    """

    ids: np.ndarray
    doc: np.ndarray
    distinct: list[bytes]


def pieces_of(texts: Texts) -> Pieces:
    data, offsets = texts.data, texts.offsets
    if not len(data):
        return Pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    space = SPACE[data]
    start = np.empty(len(data), dtype=bool)
    start[0] = True
    np.greater(space[1:], space[:-1], out=start[1:])
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(start)
    encoded = binary_array(data, np.append(at, len(data))).dictionary_encode()
    doc = np.searchsorted(offsets, at, side="right") - 1
    return Pieces(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, encoded.dictionary.to_pylist())


@dataclass
class Words:
    """Words without white space, in text order: ids into `distinct`, and the text each is from."""

    ids: np.ndarray
    doc: np.ndarray
    distinct: list[bytes]


def words_of(texts: Texts, change=None) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts; `change` maps each distinct one, b"" leaves it out."""
    pieces = pieces_of(texts)
    index: dict[bytes, int] = {}
    stripped = [p.lstrip(b" \t\n\x0b\x0c\r") for p in pieces.distinct]
    if change is not None:
        stripped = [change(p) if p else p for p in stripped]
    to_word = np.fromiter((index.setdefault(p, len(index)) if p else -1 for p in stripped), np.int64, len(stripped))
    ids = to_word[pieces.ids] if len(pieces.ids) else pieces.ids
    kept = ids >= 0
    return Words(ids[kept], pieces.doc[kept], list(index))


def lower_ascii(word: bytes) -> bytes:
    return word.lower()  # of bytes: A-Z only


def spread(values: list[bytes], ids: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays (as bytes) named by `ids` laid end to end, and where each starts (with the end appended)."""
    flat = np.frombuffer(b"".join(values), dtype=dtype)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    firsts = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(lengths, out=firsts[1:])
    counts = lengths[ids]
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(counts, out=starts[1:])
    positions = np.arange(starts[-1]) - np.repeat(starts[:-1] - firsts[ids], counts)
    return flat[positions], starts
