"""Substring deduplication by level-wise doubling over words.

Windows of a few words that repeat anywhere are extended to twice their length, those
that still repeat again to twice, until the wanted length is reached or none is left. At a level
shorter than the window only the smallest-hashed gram of each surviving window is counted
(see ``repeats``): a window survives if that gram repeats. At the last level every surviving
window is counted by a 128-bit hash. Words covered by a repeated window are removed, all
occurrences alike, judged on the input.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff, gram_hash, sha_hex, string_parts, text_key, word_hashes, word_lanes
from patchlens.llm.repeats import (anchor_places, candidates, in_any, repeated_hashes, row_lists, signatures,
                                   window_minima, window_starts)

SECOND_BASE = 0xD1342543DE82EF95


def levels(window: int, least: int = 9) -> list[int]:
    """Lengths from at least ``least`` words, each at most twice the one before, up to the window."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _surviving(words, rows, window, sizes, lists) -> np.ndarray:
    """Window starts whose smallest gram repeats at each of the levels ``sizes``."""
    starts = window_starts(rows, len(words), window)
    for size, column in zip(sizes, lists):
        if starts.any():
            low = window_minima(gram_hash(words, size), size, window)
            starts[starts] = in_any(low[starts], column)
    return starts


def _anchors(words, starts, window, size):
    grams = gram_hash(words, size)
    places = anchor_places(grams, window_minima(grams, size, window), starts)
    return places, grams[places]


def _joined(buf: np.ndarray, off: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [sha_hex(b" ".join(data[a:b].split())) for a, b in zip(off[:-1], off[1:])]


def _next_level(texts: DataFrame, window: int, sizes: list[int], size: int) -> DataFrame:
    """(id, anchors) at ``size`` words of the windows that survive the levels ``sizes``; columns h0, h1, ... hold their hashes."""
    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text")):
                n = len(off) - 1
                words, rows, _, _ = word_hashes(buf, off)
                starts = _surviving(words, rows, window, sizes, [batch.column(f"h{i}").slice(first, n) for i in range(len(sizes))])
                places, values = _anchors(words, starts, window, size)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), row_lists(places, rows, values)], ["id", "anchors"])

    return texts.drop("key").mapInArrow(run, "id long, anchors array<long>")


def _windows(texts: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """(a, b, id, word): 128-bit hash of every surviving window and where it starts in its text."""
    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text")):
                n = len(off) - 1
                words, second, rows, _, _ = word_lanes(buf, off)
                starts = np.flatnonzero(_surviving(
                    words, rows, window, sizes, [batch.column(f"h{i}").slice(first, n) for i in range(len(sizes))]))
                if not len(starts):
                    continue
                row = np.searchsorted(rows, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram_hash(words, window)[starts].view(np.int64)),
                    pa.array(gram_hash(second, window, SECOND_BASE)[starts].view(np.int64)),
                    batch.column("id").slice(first, n).take(pa.array(row)), pa.array((starts - rows[row]).astype(np.int32)),
                ], ["a", "b", "id", "word"])

    return texts.drop("key").mapInArrow(run, "a long, b long, id long, word int")


def _cleaned(texts: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_sha256, kept, spans) from texts with ``words``, the starts of repeated windows."""
    def run(batches):
        for batch in batches:
            keys, out = batch.column("key"), ([], [], [], [], [])
            starts = batch.column("words")
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = starts[i].values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for column, value in zip(out, (keys[i].as_py(), int(gone.sum()), sha_hex(kept), kept.decode(),
                                               edge.reshape(-1, 2).tolist())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
                ["key", "n_removed", "kept_sha256", "kept", "spans"])

    return texts.mapInArrow(run, "key binary, n_removed long, kept_sha256 string, kept string, spans array<array<long>>")


def repeated_words(docs: DataFrame, work: Handoff, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(rows, cleaned) of ``docs`` (doc_id, text).

    rows, one per row of docs: doc_id, key, n_words, whole_sha256 and copies (rows with an equal text). cleaned, one per
    distinct text that loses words to another text or to itself: key, n_removed, kept_sha256, kept (the words
    left, joined by one blank) and spans (removed runs of words); a row that repeats with its id may stand twice. A text of ``window`` words or more with copies loses
    all of them, whether or not it is in cleaned; ``summary`` puts both together.

    Null texts count as empty and have no words. Repeated rows are copies of each other. Null ids are ids
    like any other. An empty table gives empty results. Other columns are not read.
    """
    sizes = levels(window)
    first = sizes[0]

    def find(buf, off):
        words, rows, _, _ = word_hashes(buf, off)
        places, values = _anchors(words, window_starts(rows, len(words), window), window, first)
        return rows, places, values

    marks = signatures(docs, work, find, _joined)
    copies, texts = candidates(docs, marks, work)
    stored, texts = texts, texts.withColumnRenamed("hashes", "h0")
    for i, size in enumerate(sizes[1:-1], 1):
        hashes = repeated_hashes(_next_level(texts, window, sizes[:i], size), work)
        wider = work.write(texts.join(hashes.withColumnRenamed("hashes", f"h{i}"), "id"), "texts")
        work.drop(stored, hashes)
        stored = texts = wider
    # The windows are made twice, once for their counts and once to be found among these: hashing them again
    # takes less than keeping them. Nothing but shuffles is below the join, so a hot window can be split.
    found = _windows(texts, window, sizes[:-1])
    twice = work.write(found.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "twice")
    starts = found.join(twice, ["a", "b"]).groupBy("id").agg(F.collect_set("word").alias("words"))
    cleaned = work.write(_cleaned(
        texts.select("id", "key", "text").join(starts, "id").select("key", "text", "words"), window), "cleaned")
    work.drop(stored, twice)
    rows = marks.select("doc_id", "key", F.col("n_units").alias("n_words"), "whole_sha256").join(copies, "key")
    return rows, cleaned


def summary(docs: DataFrame, work: Handoff, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank) of every row of docs."""
    rows, cleaned = repeated_words(docs, work, window)
    gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = rows.join(cleaned.select("key", "n_removed", "kept_sha256").dropDuplicates(["key"]), "key", "left")
    return out.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(sha_hex(b""))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, work: Handoff, window: int = 35) -> DataFrame:
    """All rows and columns of ``docs``; a text that loses words becomes its kept words joined by
    one blank (n_chars, if there, their number of characters); other texts stay as they are.

    Null and empty texts stay null and empty; repeated rows are copies of each other; an empty table gives an empty one. Columns named __k, __key
    or __kept are an error.
    """
    if clash := {"__k", "__key", "__kept"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    rows, cleaned = repeated_words(docs.select("doc_id", "text"), work, window)
    empty = rows.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("key", F.lit("").alias("__kept")).distinct()
    rest = cleaned.join(empty, "key", "left_anti").select("key", F.col("kept").alias("__kept"))
    new = empty.unionByName(rest).withColumnRenamed("key", "__key")
    out = docs.withColumn("__k", text_key()).join(new, F.col("__k") == F.col("__key"), "left")
    text = F.coalesce("__kept", "text")
    return out.select(*[
        text.alias(c) if c == "text"
        else F.when(F.col("__kept").isNotNull(), F.length("__kept").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns])
