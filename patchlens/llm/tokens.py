"""Token ids of whole texts, chunk by chunk, from distinct chunks.

The split pattern of byte-level BPE puts a blank between two non-blank characters
at the head of what follows, so a text may be cut before each such blank
and the parts encoded on their own. Splitting and numbering the parts is one Arrow kernel
each; only distinct parts that a worker has not seen reach the encoder.
"""
from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where blanks meet other white space the pattern looks further than one blank.
_UNSAFE = r"[\s\x1c-\x1f\x85\p{Z}] | [\s\x1c-\x1f\x85\p{Z}]|^ | $"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class ChunkEncoder:
    """Ids of texts by ``encode``: list of str -> list of bytes (ids as little-endian uint32).

    ``remember``: distinct chunks that a worker keeps. They are kept in two halves: a chunk that
    is met again moves to the younger half, and when that is full the older one is forgotten.
    """

    def __init__(self, encode, remember: int = 1 << 19):
        self.encode, self.half, self.young, self.old = encode, remember // 2, {}, {}

    def _table(self, parts: list[str]):
        """Flat ids of the parts, and where each part's ids begin."""
        young, old = self.young, self.old
        found = [young.get(p) or old.get(p) for p in parts]
        at = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(at, self.encode([parts[i] for i in at])):
            found[i] = ids
        if len(young) + len(parts) > self.half:
            young, self.old = {}, young
        if len(parts) <= self.half:
            young.update(zip(parts, found))
        self.young = young
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.concatenate([[0], np.cumsum(size)])
        return np.frombuffer(b"".join(found), "<u4"), begin

    def batch(self, texts: pa.Array):
        """(ids of all texts, where each text's ids begin); nulls count as empty."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if odd.any():
            parts = lists.to_pylist() if odd.mean() > 0.5 else None
            if parts is None:
                lists = self._with_odd(texts, lists, odd)
            else:
                for i in np.flatnonzero(odd):
                    parts[i] = _CUT.split(texts[int(i)].as_py())
                lists = pa.array(parts, pa.list_(pa.string()))
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values[off[0]:off[-1]]
        off = off - off[0]
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_pylist()
        head = np.zeros(len(code), bool)
        head[off[:-1]] = True  # every text has a first part, if only an empty one
        spaced, bare = (np.flatnonzero(np.bincount(code[m], minlength=len(names))) for m in (~head, head))
        ids, begin = self._table([" " + names[c] for c in spaced] + [names[c] for c in bare])
        row = np.zeros((2, len(names)), np.int64)
        row[0, spaced] = np.arange(len(spaced))
        row[1, bare] = len(spaced) + np.arange(len(bare))
        at = row[head.astype(np.int64), code]
        size = begin[at + 1] - begin[at]
        end = np.cumsum(size)
        total = int(end[-1])
        out = ids[np.repeat(begin[at] - (end - size), size) + np.arange(total)]
        return out, np.concatenate([[0], end])[off]

    @staticmethod
    def _with_odd(texts, lists, odd):
        """The lists with those of odd texts cut by the careful pattern."""
        where = np.flatnonzero(odd)
        careful = pa.array([_CUT.split(texts[int(i)].as_py()) for i in where], lists.type)
        order = np.arange(len(lists))
        order[where] = len(lists) + np.arange(len(where))
        return pa.concat_arrays([lists, careful]).take(pa.array(order))


def text_slices(texts, step: int = 2 << 20):
    """(first row, rows) of about ``step`` bytes of text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size + 1)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(end, (end[i - 1] if i else 0) + step, side="right"))
        j = min(len(texts), max(j, i + 1))
        yield i, texts.slice(i, j - i)
        i = j
