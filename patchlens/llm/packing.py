"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition, in the order they are read, make one stream of
ids in which every document ends with an end id. Cuts may fall at the end of a document (free), after a
sentence (a truncation penalty), and, only where a sentence is so long that no
other cut is near, inside it (a larger penalty). best[j], the least padding plus penalties of
all cuts up to j, is

    penalty[j] + window - at[j] + min over i with at[j] - at[i] <= window of (best[i] + at[i]),

a minimum over a sliding range of i, which a monotone queue gives in constant time.

The stream is cut into blocks of about ``BLOCK_IDS`` ids at document ends, so a task holds one
block (or one longer document) at a time; the last window of a block is padded. No row is shuffled.
"""
from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from patchlens.llm.common import bounded_batches
from patchlens.llm.tokens import ChunkEncoder, little, text_slices

#: Ids of a block; its last window's padding is at most window / BLOCK_IDS of it.
BLOCK_IDS = 1 << 20
#: Text bytes that are split and numbered at once: distinct chunks are fewer in longer slices.
SLICE_BYTES = 4 << 20
SENTENCE, INSIDE = 4, 16  # truncation penalties, in padded ids


def cut_points(ids: np.ndarray, doc_end: np.ndarray, sentence_end: np.ndarray, window: int):
    """(positions, penalties) where a cut may fall, the stream's ends included; no gap exceeds window // 32.

    ids: the stream; doc_end: positions after each document; sentence_end: bool by id.
    """
    step = max(1, window // 32)
    ends = sentence_end[ids]
    ends[doc_end - 1] = True
    at = np.flatnonzero(ends) + 1
    gap = np.diff(at, prepend=0)
    more = (gap - 1) // step  # cuts inside the gap before each place
    which = np.repeat(np.arange(len(at)), more)
    inside = (at - gap)[which] + (np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1) * step
    penalty = np.full(len(ids), SENTENCE, np.int8)
    penalty[inside - 1] = INSIDE
    penalty[doc_end - 1] = 0
    ends[inside - 1] = True
    at = np.flatnonzero(ends) + 1
    return at, penalty[at - 1]


def best_cuts(at, penalty, window: int) -> list[int]:
    """The cut positions (each window's end) of least padding plus penalties.

    The stream's last window counts its padding like any other. Ties: the longest window.
    """
    at, penalty = [0, *at.tolist()], [0, *penalty.tolist()]
    n = len(at)
    before = [0] * n
    queue = deque([(0, 0, 0)])  # (best[i] + at[i], at[i], i), keys rising
    for j in range(1, n):
        here = at[j]
        while queue[0][1] < here - window:
            queue.popleft()
        key, _, i = queue[0]
        before[j] = i
        mine = key + window + penalty[j]  # best[j] + at[j]
        while queue and queue[-1][0] > mine:
            queue.pop()
        queue.append((mine, here, j))
    out, j = [], n - 1
    while j:
        out.append(at[j])
        j = before[j]
    return out[::-1]


def pack_block(ids: np.ndarray, doc_end: np.ndarray, sentence_end: np.ndarray, window: int):
    """Pieces of one block: (document, position in the stream, length, window, offset in it)."""
    at, penalty = cut_points(ids, doc_end, sentence_end, window)
    cuts = np.array(best_cuts(at, penalty, window), np.int64)
    end = np.union1d(cuts, doc_end)
    start = np.concatenate([[0], end[:-1]])
    seq = np.searchsorted(cuts, start, side="right")
    seq_start = np.concatenate([[0], cuts])[seq]
    return np.searchsorted(doc_end, start, side="right"), start, end - start, seq, start - seq_start


def _ranks(path: str) -> dict | None:
    """bytes -> id of a byte-level vocabulary file, if its merges are numbered in their order, so that ids are ranks; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # a byte-level vocabulary shows other bytes from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [i for w, i in vocab.items() if len(w) == 1]
    if made != sorted(made) or len(single) != 256 or max(single) > made[0]:
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if len(w) == 1 or i >= made[0] and all(c in byte for c in w)}


@lru_cache(2)
def _encoder(path: str, pattern: str | None):
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # such strings in a text are ordinary text
    ranks = _ranks(path) if pattern else None
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    n = tok.get_vocab_size()
    size = np.zeros(n, np.int64)
    for word, i in tok.get_vocab().items():
        size[i] = len(word)  # a byte-level vocabulary spells each byte as one character

    def by_library(text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def by_ranks(text: str) -> np.ndarray:
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def joined(chunks: list[str], encoder) -> list[bytes]:
        """Chunks that may follow each other in one text: encoded as one, and cut where their bytes end."""
        ids = encoder("".join(chunks))
        ends_at = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        cut = np.searchsorted(np.cumsum(size[ids]), ends_at, side="right") * 4
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *cut[:-1].tolist()], cut.tolist())]

    def encode(chunks: list[str]) -> list[bytes]:
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace()]
        # Of Latin letters every release of Unicode says the same; of others the two libraries' tables might not.
        latin = [fast is not None and (chunks[i].isascii() or max(chunks[i]) < "\u0250") for i in plain]
        for encoder, most, mine in ((by_ranks, 1 << 16, [i for i, x in zip(plain, latin) if x]), (by_library, 1 << 10, [i for i, x in zip(plain, latin) if not x])):
            for i in range(0, len(mine), most):
                part = mine[i:i + most]
                for k, ids in zip(part, joined([chunks[k] for k in part], encoder)):
                    out[k] = ids
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = little(tok.encode(chunks[k], add_special_tokens=False).ids)
        return out

    ends = np.zeros(n, bool)
    for word, i in tok.get_vocab().items():
        # Byte-level vocabularies spell a newline as U+010A.
        ends[i] = word[-1] in ".!?Ċ" if word else False
    return ChunkEncoder(encode), ends


def pack(docs: DataFrame, path: str, *, pattern: str | None = None, window: int = 1024, end_id: int = 0,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document, whole texts, no id lost or repeated.

    doc_id, start (ids of the document before the piece), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (the document's ids with its end id),
    sequence_id, offset (in the sequence, gapless from 0). Sequences are padded to ``window`` by the reader.
    ``path``: a byte-level vocabulary file of the tokenizers library; with its split ``pattern``, chunks of Latin letters are
    encoded by ranks, to the same ids in less time. Null and empty texts
    are one end id. Repeated rows and null ids are packed like any other row. Other columns are not read.
    """
    def run(batches):
        encoder, ends = _encoder(path, pattern)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple] = []

        def flush():
            nonlocal sequence, held
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            names = pa.concat_arrays([h[2] for h in held])
            held = []
            doc_end = np.cumsum(size)
            doc, start, length, seq, offset = pack_block(ids, doc_end, ends, window)
            raw = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            off = pa.py_buffer((np.append(start, len(ids)) * 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(doc)), pa.array(start - (doc_end - size)[doc]), pa.array(length),
                pa.Array.from_buffers(pa.binary(), len(start), [None, off, raw]),
                pa.array(size[doc]), pa.array(seq + sequence), pa.array(offset),
            ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += int(seq[-1]) + 1

        for batch in batches:
            names = batch.column("doc_id")
            for i, part in text_slices(batch.column("text"), SLICE_BYTES):
                flat, begin = encoder.batch(part)
                size = np.diff(begin) + 1
                out = np.full(len(flat) + len(part), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(size) - 1] = False
                out[keep] = flat
                held.append((out, size, names.slice(i, len(part))))
                if sum(len(h[0]) for h in held) >= BLOCK_IDS:
                    yield from flush()
        yield from flush()

    bounded_batches(docs.sparkSession)
    schema = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return rows.mapInArrow(run, schema)
