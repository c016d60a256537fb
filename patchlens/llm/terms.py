"""Terms of texts: runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.

``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` over UTF-8 bytes: a byte from 0x80 up belongs to a character beyond
ASCII, so whole characters are kept. All steps are numpy or Arrow kernels over a part of a batch.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def runs(inside: np.ndarray, off: np.ndarray):
    """Bounds of the runs of ``inside`` bytes, none across a row's end, and the number of runs before each row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(inside)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def coded(buf: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """(code of every run, the distinct runs as a binary array); the runs are all bytes with ``inside``."""
    body = np.ascontiguousarray(buf[inside])
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=off[1:])
    each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(body)]).dictionary_encode()
    return each.indices.to_numpy().astype(np.int64), each.dictionary


def terms(buf: np.ndarray, off: np.ndarray):
    """(code of every term, number of terms before each row, the distinct terms as large_binary)."""
    inside = _IN_TERM[buf]
    start, stop, rows = runs(inside, off)
    codes, names = coded(_LOWER[buf], inside, start, stop)
    return codes, rows, names


def hashes(names: pa.Array) -> np.ndarray:
    """XXH64 of every entry."""
    return np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))
