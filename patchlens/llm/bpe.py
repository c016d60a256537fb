"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the table ``last`` holds the one token that ends the
prefix's encoding. A token t may end prefix i if the prefix before it, i - len(t), has an
encoding whose last token stands next to t without merging across; exactly one token
does. The table never looks ahead, so appended bytes extend it, and after an
edit it is recomputed from the edit until it agrees with the old one for as many
positions as the longest token has bytes.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from patchlens.llm.common import bounded_batches
from patchlens.llm.tokens import ChunkEncoder, little, text_slices


#: Pairs of neighbours whose verdict a worker keeps, and distinct pieces whose ids it keeps.
PAIRS, PIECES = 1 << 17, 1 << 16


class Vocabulary:
    """Ranks of byte strings; a rank is the id. Every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.bytes_of):
            self.split[i] = pair = self._parts(self.bytes_of[i], i)
            if pair:
                self.merged[pair] = i
        self.beside: dict[int, bool] = {}
        self.finder = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.finder.add_word(b.decode("latin-1"), (len(b), i))
        self.finder.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)})

    def _parts(self, word: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``word``, by merging ranks under ``below`` from its bytes."""
        parts = [word[i:i + 1] for i in range(len(word))]
        if len(parts) == 1:
            return None
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                return None  # no merges lead to it: it is found only as a whole piece
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when the bytes of both are encoded together.

        Undo the merges of both sides latest first, as far as the seam sees them: a
        merge across the seam that ranks before the one just undone would have come first.
        """
        pair = a << 32 | b
        known = self.beside.get(pair)
        if known is not None:
            return known
        left, right, bound = a, b, 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                ok = False
                break
            on_left, on_right = self.split[left], self.split[right]
            if on_left is None and on_right is None:
                ok = True
                break
            # Of equal or higher ranked sides the right one's merge came later in a scan from the left.
            if on_right is None or (on_left is not None and left > right):
                bound, left = left, on_left[1]
            else:
                bound, right = right + 1, on_right[0]
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        self.beside[pair] = ok
        return ok


class Prefixes:
    """The table of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; nothing that is there is computed again."""
        self._extend(more, None)

    def _extend(self, more: bytes, old: list[int] | None) -> None:
        """old: the entries that stood here for the same trailing bytes, if any."""
        voc, last = self.vocabulary, self.last
        begin = len(last)
        self.piece += more
        back = max(0, begin - voc.longest + 1)
        agree = 0
        text = self.piece[back:].decode("latin-1")
        for end, (size, token) in voc.finder.iter(text):
            end += back + 1
            if end <= begin or len(last) >= end:
                continue
            if len(last) < end - 1:
                raise ValueError("a byte has no encoding")
            before = end - size
            if before == 0 or voc.fits(last[before - 1], token):
                last.append(token)
                if old is not None:
                    tail = len(old) - (len(self.piece) - end) - 1
                    agree = agree + 1 if tail >= 0 and old[tail] == token and size <= tail + 1 else 0
                    if agree >= voc.longest:
                        last.extend(old[tail + 1:])
                        return

    def edit(self, at: int, remove: int, insert: bytes) -> None:
        """Replace ``remove`` bytes at ``at``; only entries near the edit are computed anew."""
        tail, old = self.piece[at + remove:], self.last[at + remove:]
        self.piece, self.last = self.piece[:at], self.last[:at]
        self.append(insert)
        self._extend(tail, old)

    def ids(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= len(self.vocabulary.bytes_of[t])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of a piece that stays as it is: the table alone, without the means to change it."""
    whole = vocabulary.ranks.get(piece)
    if whole is not None:
        return [whole]
    last, sizes, n = [], [], 0
    beside, fits = vocabulary.beside, vocabulary.fits
    for end, (size, token) in vocabulary.finder.iter(piece.decode("latin-1")):
        if end < n:
            continue
        before = end + 1 - size
        if before:
            left = last[before - 1]
            ok = beside.get(left << 32 | token)
            if not (fits(left, token) if ok is None else ok):
                continue
        last.append(token)
        sizes.append(size)
        n += 1
    if n != len(piece):
        raise ValueError("a byte has no encoding")
    out = []
    while n:
        out.append(last[n - 1])
        n -= sizes[n - 1]
    return out[::-1]


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_file(path)


@lru_cache(2)
def _token_bytes(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        known = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines)}
    return [known.get(i, b"") for i in range(max(known) + 1)]


@lru_cache(2)
def _chunks(path: str, pattern: str) -> ChunkEncoder:
    voc, split, pieces = _vocabulary(path), regex.compile(pattern), {}

    def one(chunk: str) -> bytes:
        ids = []
        for piece in split.findall(chunk):
            got = pieces.get(piece)
            if got is None:
                if len(pieces) >= PIECES:
                    pieces.clear()
                got = pieces[piece] = little(encode_piece(voc, piece.encode()))
            ids.append(got)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    return ChunkEncoder(lambda chunks: [one(c) for c in chunks])


def _encoded(batches, path: str, pattern: str, keep: list[str], text: str, ids: str):
    encoder = _chunks(path, pattern)
    for batch in batches:
        for i, part in text_slices(batch.column(text)):
            flat, begin = encoder.batch(part)
            raw = pa.py_buffer(flat.astype("<u4").tobytes())
            off = pa.py_buffer((begin * 4).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(i, len(part)) for c in keep]
                + [pa.Array.from_buffers(pa.binary(), len(part), [None, off, raw])], [*keep, ids])


def _decoded(batches, path: str, names: list[str], ids: str, out: str):
    table = _token_bytes(path)
    for batch in batches:
        done = [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) if x else b""
                for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(done, pa.binary())], [*names, out])


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers (binary).

    ``path``: a rank file; ``pattern`` splits a text into pieces that are encoded on
    their own, without special tokens. Null texts count as empty (no ids). The text column is dropped;
    any other column, repeated rows included, passes through. ``ids`` must not be among them.
    """
    keep = [c for c in docs.columns if c != text]
    if ids in keep:
        raise ValueError(f"a column {ids} is there already")
    bounded_batches(docs.sparkSession)
    schema = StructType([*docs.select(*keep).schema.fields, StructField(ids, BinaryType(), False)])
    return docs.select(*keep, text).mapInArrow(lambda b: _encoded(b, path, pattern, keep, text, ids), schema)


def decode(df: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that ``ids`` stand for. A null or empty ``ids`` gives no bytes; repeated rows stay, an
    empty table gives an empty one. A column ``out`` that is there already is an error."""
    names = df.columns
    if out in names:
        raise ValueError(f"a column {out} is there already")
    schema = StructType([*df.schema.fields, StructField(out, BinaryType(), False)])
    return df.mapInArrow(lambda b: _decoded(b, path, names, ids, out), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one Python step, so that a task needs one worker and the ids cross once."""
    keep = [c for c in docs.columns if c != text]
    if {ids, out} & set(keep):
        raise ValueError(f"a column {ids} or {out} is there already")
    bounded_batches(docs.sparkSession)
    schema = StructType([*docs.select(*keep).schema.fields, StructField(ids, BinaryType(), False), StructField(out, BinaryType(), False)])
    return docs.select(*keep, text).mapInArrow(
        lambda b: _decoded(_encoded(b, path, pattern, keep, text, ids), path, [*keep, ids], ids, out), schema)
