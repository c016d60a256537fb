"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a third 64-bit word within
r bits of both. So every distinct fingerprint emits all words ("variants")
within r = ceil(radius / 2) bits, the shuffle brings equal variants together, and the
fingerprints that meet at a variant are linked after their bit distance is verified.

The shuffle key is the variant's leading ``prefix_bits`` bits: a fingerprint sends
one row per reachable prefix with the flips still allowed, and the receiving task
enumerates the other bits. Both halves together are exactly the ball of variants, but 64
minus ``prefix_bits`` bits of it never cross the network. ``prefix_bits`` grows
with the number of distinct fingerprints, so that a task's slice stays of one size.

Whatever the size of a group of copies, it is one fingerprint here; fingerprints that
meet at one variant make a star, not all pairs. With an even radius all of them are
within the radius of each other, so the star loses no link between components.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff, bounded_batches, string_parts
from patchlens.llm.graph import connected_components

BITS = 64
#: Distinct fingerprints whose whole ball may fall on one prefix, on average.
BALLS_PER_PREFIX = 64
#: Variants enumerated at once inside a task.
VARIANTS_AT_ONCE = 1 << 22


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of one text: a bit is set if it is set in over half of the shingle hashes.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle`` words,
    repeats included, joined by one blank; fewer words make one shingle; none gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cut, digest = memoryview(line), xxhash.xxh64_intdigest
    a, b = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    count, total = np.zeros(BITS, np.int64), len(a)
    for i in range(0, total, 1 << 16):  # a block at a time, so that a long text needs no more memory
        h = np.fromiter((digest(cut[x:y], 42) for x, y in zip(a[i:i + (1 << 16)], b[i:i + (1 << 16)])), np.uint64)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * count > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, text: str = "text", keep: tuple = ("doc_id",), out: str = "fp") -> DataFrame:
    """``keep`` columns and ``out``, the fingerprint's 64 bits as a signed long; null texts count as empty."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            fp = np.empty(len(texts), np.uint64)
            for first, buf, off in string_parts(texts):
                data = buf.tobytes()
                for i in range(len(off) - 1):
                    fp[first + i] = fingerprint(data[off[i]:off[i + 1]], shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(fp.view(np.int64))], [*keep, out])

    schema = rows.drop("__text").schema.add(out, "long", False)
    return rows.mapInArrow(run, schema)


def ball(bits: int, radius: int) -> list[np.ndarray]:
    """Masks of ``bits`` bits with exactly 0, 1, ... ``radius`` bits set."""
    out = []
    for r in range(radius + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(bits), r)] if r <= bits else []
        out.append(np.array(masks, np.uint64))
    return out


def spread(fps: DataFrame, prefix_bits: int, radius: int) -> DataFrame:
    """(slice, fp, left): every prefix that a variant of fp may have, and the flips left for its other bits."""
    low = BITS - prefix_bits
    masks = ball(prefix_bits, radius)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 12):
                part = fp[i:i + (1 << 12)]
                head = part >> np.uint64(low)
                for r, m in enumerate(masks):
                    if len(m):
                        keys = (head[:, None] ^ m[None, :]).ravel().astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(np.repeat(part, len(m)).view(np.int64)),
                             pa.array(np.full(len(keys), radius - r, np.int8))], ["slice", "fp", "left"])

    return fps.select("fp").mapInArrow(run, "slice long, fp long, left byte")


def _stars(fp: np.ndarray, left: np.ndarray, low: int, radius: int, masks: list[np.ndarray], max_bits: int):
    """Star edges among the fingerprints of one slice whose variants meet; masks: by flips, over the low bits.

    Splits the slice by its next bit while it would enumerate too many variants at once.
    """
    count = sum(int((left >= r).sum()) * len(m) for r, m in enumerate(masks))
    if len(fp) < 2:
        return
    if count > VARIANTS_AT_ONCE and low > 1:
        bit = np.uint64(1) << np.uint64(low - 1)
        sub = [m[m < bit] for m in masks]
        own = (fp & bit) != 0
        for side in (False, True):
            there = own == side
            other = ~there & (left > 0)
            yield from _stars(np.concatenate([fp[there], fp[other]]),
                              np.concatenate([left[there], left[other] - 1]), low - 1, radius, sub, max_bits)
        return
    keep = np.uint64((1 << low) - 1)
    tail = fp & keep
    values = np.concatenate([(tail[left >= r][:, None] ^ m[None, :]).ravel() for r, m in enumerate(masks)])
    # Variants that occur once are dropped on their value alone; only the rest get their owners.
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, values)
    at[at == len(twice)] = 0
    hit = np.flatnonzero(twice[at] == values)
    owner = np.concatenate([np.repeat(np.flatnonzero(left >= r), len(m)) for r, m in enumerate(masks)])[hit]
    order = np.lexsort((fp[owner], at[hit]))
    group, member = at[hit][order], fp[owner][order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    centre = member[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    a, b = centre[~head], member[~head]
    near = np.bitwise_count(a ^ b) <= max_bits
    if near.any():
        yield np.unique(np.stack([a[near], b[near]], 1), axis=0)


def links(fps: DataFrame, work: Handoff, *, radius: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """Star edges (a, b) whose components are those of all pairs within ``radius`` bits.

    ``fps``: a column fp (long), repeats allowed, nulls left out; an empty table has no edges. ``radius`` must be even: then any
    two fingerprints that meet are within it.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: a ball of half the radius around a variant must be a clique")
    half = radius // 2
    distinct = work.write(fps.select("fp").where("fp is not null").distinct(), "fps")
    if prefix_bits is None:
        n = distinct.count()
        prefix_bits = min(48, max(6, (max(n, 1) // BALLS_PER_PREFIX).bit_length()))
    low = BITS - prefix_bits

    def run(batches):
        masks = ball(low, half)
        kept, key = [], None

        def flush():
            fp = np.concatenate([x[0] for x in kept])
            left = np.concatenate([x[1] for x in kept])
            found = list(_stars(fp, left, low, radius, masks, radius))
            if found:
                e = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(e[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            s = batch.column("slice").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            left = batch.column("left").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
            for i, j in zip(cut[:-1], cut[1:]):
                if i == j:
                    continue
                if key is not None and s[i] != key:
                    yield from flush()
                    kept = []
                key = s[i]
                kept.append((fp[i:j], left[i:j]))
        if kept:
            yield from flush()

    sliced = spread(distinct, prefix_bits, half).repartition("slice").sortWithinPartitions("slice")
    return sliced.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, work: Handoff, *, shingle: int = 4, radius: int = 4,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (16 hex digits), root (the component's smallest fp) and
    component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Rows
    that repeat give repeated rows. A null doc_id gets a row, and is a component's id only if the
    component has no other. An empty table gives an empty result.
    """
    prints = work.write(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                     shingle=shingle), "prints")
    edges = work.write(links(prints, work, radius=radius), "edges")
    comp = connected_components(edges, work)
    # Smallest ids first by fingerprint, then by component; the documents meet only the finished map,
    # in a join with nothing but shuffles below it, so that a fingerprint of very many copies can be split.
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low")) \
        .join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    low = work.write(low.select("fp", "low", "root"), "low")
    first = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = work.write(low.join(first, "root").select("fp", "root", "component_id"), "named")
    work.drop(low)
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def deduplicated(docs: DataFrame, work: Handoff, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents that are the first (smallest doc_id) of their component, all columns kept.

    Of rows that share this doc_id one stays. Rows without a doc_id stay only where
    their component has no doc_id at all, and then one of them. Null, empty and blank texts are copies of each other;
    an empty table gives an empty one. Columns named __id, __own, __fp, __root, __first or __n are an error.
    """
    if clash := {"__id", "__own", "__fp", "__root", "__first", "__n"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    marked = work.write(near_duplicates(docs, work, shingle=shingle, radius=radius), "marked")
    # Ids that several rows share, or that are missing, can't name a row: those rows are looked at again.
    odd = work.write(marked.groupBy("doc_id").count().where("count > 1 or doc_id is null")
                     .select(F.col("doc_id").alias("__id")), "odd")
    by_id = F.col("doc_id").eqNullSafe(F.col("__id"))
    drop = marked.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    if not odd.take(1):
        return docs.join(drop, by_id, "left_anti")
    rest = docs.join(drop.unionByName(odd), by_id, "left_anti")
    again = fingerprints(docs.join(odd, by_id, "left_semi"), shingle=shingle, keep=tuple(docs.columns), out="__own")
    roots = marked.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__first")).distinct()
    first = Window.partitionBy("__root").orderBy(F.xxhash64(F.col("text")), F.col("text"))
    again = (again.join(roots, F.col("__own") == F.col("__fp")).where(F.col("doc_id").eqNullSafe(F.col("__first")))
             .withColumn("__n", F.row_number().over(first)).where("__n = 1"))
    return rest.unionByName(again.select(*docs.columns))
