"""Text batches as numpy arrays: words, 64-bit hashes and compact blobs for Python-side operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Text bytes handled at a time; with their arrays about thirty times as much memory.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task should not hold the arrays of its last."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` text bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of non-null texts: index of each word into the unique words, n + 1 offsets, unique words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    unique = coded.dictionary
    empty = np.flatnonzero(pc.equal(pc.binary_length(unique), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # what stands before leading or after trailing white space
        keep = index != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return index, offsets, unique


def hash_strings(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each item, the index of the document whose offsets hold it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = np.ascontiguousarray(values, np.uint64)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T if len(values) else np.zeros((width, 0), np.uint8)
    head = np.array([len(values), width], "<u4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n, width = np.frombuffer(blob, "<u4", 2)
    out = np.zeros((int(n), 8), np.uint8)
    if n:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
        out[:, :width] = planes.reshape(int(width), int(n)).T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)) if len(values) else values)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _edges(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def parts(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n + 1 cuts of ascending uint64 hashes into n equal ranges of values."""
    return np.concatenate([[0], np.searchsorted(sorted_hashes, _edges(n)), [len(sorted_hashes)]])
