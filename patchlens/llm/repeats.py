"""Candidates for exact repeats: the distinct texts that may share a window with another place.

A window of W units holds W - L + 1 grams of L units; its anchor is the gram of the smallest
hash. Equal windows have equal anchors, so a window can only repeat if its anchor's
hash occurs at two places, and only the anchors (about 2 in W - L + 2 grams) are counted over
the corpus. A text that is there more than once is looked at once; its copies are known
to repeat as a whole.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import STEP_BYTES, Handoff, sliding, string_parts, text_key


def window_starts(rows: np.ndarray, total: int, window: int) -> np.ndarray:
    """For every place where a run of ``window`` units fits: whether it stays inside one row."""
    n = max(0, total - window + 1)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return owner[:n] == owner[window - 1:window - 1 + n]


def window_minima(grams: np.ndarray, size: int, window: int) -> np.ndarray:
    """The smallest gram hash of every window."""
    w = window - size + 1
    return sliding(np.minimum, grams, w) if len(grams) >= w else grams[:0]


def anchor_places(grams: np.ndarray, minima: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of grams that are the smallest of a window that begins at one of ``starts`` (bool)."""
    w = len(grams) - len(minima) + 1
    if not len(minima):
        return np.zeros(0, np.int64)
    kept = np.where(starts, minima, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([pad, kept, pad]), w) == grams) if w > 1 else np.flatnonzero(kept == grams)


def row_lists(places: np.ndarray, rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values at the places of each row, as lists."""
    off = np.searchsorted(places, rows).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.uint64).view(np.int64)))


def signatures(docs: DataFrame, work: Handoff, find: Callable, whole: Callable, step: int = STEP_BYTES) -> DataFrame:
    """doc_id, key, n_units, whole_sha256, anchors (array of long) of every row.

    find(buf, off) -> (row bounds in units, anchor places, anchor hashes); whole(buf, off) -> hex digest of each row.
    """
    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text"), step):
                rows, places, values = find(buf, off)
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n),
                    pa.array(np.diff(rows).astype(np.int64)), pa.array(whole(buf, off), pa.string()),
                    row_lists(places, rows, values)], ["doc_id", "key", "n_units", "whole_sha256", "anchors"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return work.write(rows.mapInArrow(
        run, "doc_id long, key binary, n_units long, whole_sha256 string, anchors array<long>"), "signatures")


def repeated_hashes(lists: DataFrame, work: Handoff) -> DataFrame:
    """(id, hashes): for every id the hashes in its list of anchors that occur twice or more over all lists.

    The counts are a table of their own, so that the join has nothing but shuffles below it and
    the adaptive skew join can split a hash that very many texts share.
    """
    each = lists.select("id", F.explode("anchors").alias("h"))
    twice = work.write(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    hashes = work.write(each.join(twice, "h").groupBy("id").agg(F.collect_set("h").alias("hashes")), "hashes")
    work.drop(twice)
    return hashes


def candidates(docs: DataFrame, marks: DataFrame, work: Handoff) -> tuple[DataFrame, DataFrame]:
    """(copies, texts) from signatures: copies has key and its number of rows;
    texts has id (a number), key, text, hashes (its repeated anchors) of each distinct text that has any."""
    distinct = marks.groupBy("key").agg(F.first("anchors").alias("anchors"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # The number is fixed once the table is written; it packs better than the key.
    distinct = work.write(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    copies = work.write(distinct.select("key", "copies"), "copies")
    hashes = repeated_hashes(distinct, work)
    chosen = hashes.join(distinct.select("id", "key", "rep"), "id").withColumnRenamed("key", "__key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    texts = rows.join(chosen, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    # Rows that repeat with their id come twice; their text repeats as a whole anyway.
    texts = work.write(texts.select("id", "key", "text", "hashes"), "texts")
    work.drop(distinct, hashes)
    return copies, texts


def in_any(values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in one of the lists (longs that stand for unsigned hashes)."""
    known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.isin(values, known)
