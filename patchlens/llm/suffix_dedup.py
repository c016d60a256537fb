"""Suffix-array deduplication of bytes.

Every window start belongs to the anchor of its window (see ``repeats``), so equal windows
belong to equal anchors. Runs of starts with one anchor become segments; the shuffle
deals them out by anchor, and each task is a shard: it sorts the suffixes of its
distinct segments by external induced sorting (``suffixes``), of which the last step orders
the window starts alone, and marks the starts in neighbourhoods that have a whole window in common.
"""
from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff, gram_hash, sha_hex, string_parts
from patchlens.llm.repeats import anchor_places, candidates, in_any, row_lists, signatures, window_minima, window_starts
from patchlens.llm.suffixes import Space, SuffixOrder

#: Text bytes of a step: the hashes of a step's bytes need about 60 times as much.
STEP = 1 << 20
#: Segment bytes that a shard gets on average. One shard sorts in about 100 times as much, in files beyond ``memory``.
SHARD_BYTES = 1 << 20
#: Anchors are this share of the window: longer ones are rarer in other texts, but overlap more.
ANCHOR = 6


def _digests(buf: np.ndarray, off: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [sha_hex(data[a:b]) for a, b in zip(off[:-1], off[1:])]


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, id, start, segment): runs of window starts with one repeated anchor, and the bytes of their windows."""
    size = max(1, window // ANCHOR)

    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text"), STEP):
                n = len(off) - 1
                starts = window_starts(off, len(buf), window)
                if not starts.any():
                    continue
                low = window_minima(gram_hash(buf, size), size, window)
                starts[starts] = in_any(low[starts], batch.column("hashes").slice(first, n))
                at = np.flatnonzero(starts)
                if not len(at):
                    continue
                row = np.searchsorted(off, at, side="right") - 1
                new = np.concatenate([[True], (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (row[1:] != row[:-1])])
                begin = at[new]
                end = np.append(at[:-1][new[1:]], at[-1]) + window
                data = buf.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(low[begin].view(np.int64)), batch.column("id").slice(first, n).take(pa.array(row[new])),
                    pa.array(begin - off[row[new]]), pa.array([data[a:b] for a, b in zip(begin, end)], pa.binary()),
                ], ["anchor", "id", "start", "segment"])

    return texts.drop("key").mapInArrow(run, "anchor long, id long, start long, segment binary")


def _repeated_starts(segments: DataFrame, window: int, memory: int, shards: int) -> DataFrame:
    """(id, runs): pairs (first start, number of starts) of repeated windows, flattened, of each segment that has any.

    A task's distinct segments go to a file as they come (equal ones stand together); only numbers are held.
    """
    def run(batches):
        space = Space(memory)
        joined = tempfile.TemporaryFile()
        begin, length, copies = [], [], []  # of distinct segments
        keys, starts, owner = [], [], []  # of rows
        total, last = 0, None
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, segment in enumerate(batch.column("segment").to_pylist()):
                if segment != last:
                    begin.append(total)
                    length.append(len(segment))
                    copies.append(0)
                    joined.write(segment + b"\0")
                    total, last = total + len(segment) + 1, segment
                copies[-1] += 1
                numbers[i] = len(begin) - 1
            keys.append(batch.column("id"))
            starts.append(batch.column("start").to_numpy())
            owner.append(numbers)
        if not begin:
            return
        joined.flush()
        raw = np.memmap(joined, np.uint8, "r", shape=(total,))
        # Symbols: 0 ends the text, 1 parts segments, a byte b is b + 2.
        text = space.array(total + 1, np.uint16)
        begin, length, copies = np.array(begin), np.array(length), np.array(copies)
        for i in range(0, total, 1 << 22):
            text[i:i + (1 << 22)][:len(raw[i:i + (1 << 22)])] = raw[i:i + (1 << 22)].astype(np.uint16) + 2
        text[begin + length] = 1
        text[total] = 0
        repeated = space.array(total, bool)
        wanted = space.array(total + 1, bool)  # only where a window begins; the others are about two of three
        for a, n in zip(begin.tolist(), length.tolist()):
            wanted[a:a + n - window + 1] = True
        seen = []  # positions and whether they share a window with the one before, of the last neighbourhood
        for _, pos, common in SuffixOrder(text, window, space).neighbours(wanted):
            seen = _mark(seen, pos, common >= window, begin, length, copies, window, repeated)
        _mark(seen, np.zeros(0, np.int64), np.zeros(0, bool), begin, length, copies, window, repeated, last=True)
        for key, start, number in zip(keys, starts, owner):
            out, rows = [], []
            for i, j in enumerate(number.tolist()):
                flags = repeated[begin[j]:begin[j] + length[j] - window + 1]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                if len(edge):
                    edge[1::2] -= edge[::2]
                    edge[::2] += start[i]
                    out.append(edge)
                    rows.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(rows)), pa.array(out, pa.list_(pa.int64()))], ["id", "runs"])

    # Equal segments stand together, so that they are read as one.
    dealt = segments.repartition(shards, "anchor").sortWithinPartitions("anchor", F.xxhash64("segment"), "segment")
    return dealt.select("id", "start", "segment").mapInArrow(run, "id long, runs array<long>")


def _mark(held, pos, joins, begin, length, copies, window, repeated, last=False):
    """Set ``repeated`` at the starts of neighbourhoods that hold two or more; the last one may go on in the next block."""
    if held:
        pos, joins = np.concatenate([held[0], pos]), np.concatenate([held[1], joins])
    if not len(pos):
        return []
    heads = np.flatnonzero(~joins)
    cut = len(pos) if last else (heads[-1] if len(heads) else 0)
    if cut:
        p, group = pos[:cut], np.cumsum(~joins[:cut])
        inside = np.flatnonzero(p < begin[-1] + length[-1])
        owner = np.searchsorted(begin, p[inside], side="right") - 1
        whole = p[inside] + window <= begin[owner] + length[owner]
        p, group, owner = p[inside][whole], group[inside][whole], owner[whole]
        if len(p):
            count = np.bincount(group, copies[owner])
            repeated[p[count[group] > 1]] = True
    return [pos[cut:], joins[cut:]]


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept, spans) from texts with ``runs``."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for key, text, runs in zip(batch.column("key"), batch.column("text"), batch.column("runs")):
                data = (text.as_py() or "").encode()
                run_ = runs.values.to_numpy().reshape(-1, 2)
                a, b = run_[:, 0], run_[:, 0] + run_[:, 1] - 1 + window
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                head = np.concatenate([[True], a[1:] > reach[:-1]])
                lo, hi = a[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)]
                kept = b"".join([data[x:y] for x, y in zip(np.append(0, hi), np.append(lo, len(data)))])
                for column, value in zip(out, (key.as_py(), int((hi - lo).sum()), len(lo), sha_hex(kept), kept,
                                               np.stack([lo, hi], 1).tolist())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))))],
                ["key", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")


def repeated_bytes(docs: DataFrame, work: Handoff, window: int = 400, memory: int = 192 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, cleaned) of ``docs`` (doc_id, text), texts as UTF-8 bytes.

    rows, one per row of docs: doc_id, key, n_bytes, whole_sha256, copies (rows with an equal text). cleaned, one per distinct
    text that loses bytes to another text or to itself: key, n_removed, n_spans, kept_sha256, kept
    (the bytes left) and spans; a row that repeats with its id may stand twice. A text of ``window`` bytes or more with copies loses all of
    them, whether or not it is in cleaned; ``summary`` puts both together.
    ``memory``: bytes of tuples a shard holds before it sorts in files.

    Null texts count as empty. Repeated rows are copies. Null ids are ids like any other. An empty
    table gives empty results. Other columns are not read.
    """
    size = max(1, window // ANCHOR)

    def find(buf, off):
        grams = gram_hash(buf, size)
        places = anchor_places(grams, window_minima(grams, size, window), window_starts(off, len(buf), window))
        return off, places, grams[places]

    marks = signatures(docs, work, find, _digests, STEP)
    copies, texts = candidates(docs, marks, work)
    # An anchor's segment is a window and, on average, as many starts as half of the grams in a window.
    places = texts.agg(F.sum(F.size("hashes"))).first()[0] or 0
    shards = max(1, places * (window + (window - window // ANCHOR) // 2) // SHARD_BYTES)
    runs = work.write(_repeated_starts(_segments(texts, window), window, memory, shards), "runs")
    merged = runs.groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    cleaned = work.write(_cut(texts.select("id", "key", "text").join(merged, "id").select("key", "text", "runs"), window), "cleaned")
    work.drop(texts, runs)
    rows = marks.select("doc_id", "key", F.col("n_units").alias("n_bytes"), "whole_sha256").join(copies, "key")
    return rows, cleaned


def summary(docs: DataFrame, work: Handoff, window: int = 400, memory: int = 192 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the kept bytes) of every row of docs."""
    rows, cleaned = repeated_bytes(docs, work, window, memory)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    out = rows.join(cleaned.select("key", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["key"]), "key", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(gone, F.lit(sha_hex(b""))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
