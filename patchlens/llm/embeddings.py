"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors are projected on many random directions. For two vectors at distance d the difference
of their projections is normal with deviation d, so a window of half-width w around the query
holds a partner at the linking distance with a known probability, and the number of windows that hold it is
binomial. ``calibrate`` turns the wanted recall into the number of misses a pair may
have; a pair with more is dropped as soon as it has them, the others are verified by
their cosine in double precision.

The first ``SORTED`` projections, with wider windows that a partner may not miss, deal the vectors out: cells as
wide as a window are sorted, and a query's windows lie in its own and the neighbouring cells. Equal vectors
are one class with a count. A cell with many queries is split into blocks that each
read the cell's candidates as a stream, so a task holds one block of queries and one batch of candidates.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff
from patchlens.llm.graph import connected_components

PROJECTIONS, SORTED = 24, 3
SORTED_DEVIATIONS, DEVIATIONS = 4.5, 3.0  # half-widths of windows, in deviations at the linking distance
BLOCK, BATCH = 2048, 1024  # queries and candidates that are counted at once


def calibrate(recall: float, projections: int = PROJECTIONS - SORTED, deviations: float = DEVIATIONS) -> int:
    """The fewest misses to allow so that a pair at the linking distance passes with probability ``recall``."""
    miss, reached = 1 - erf(deviations / sqrt(2)), 0.0
    for k in range(projections + 1):
        reached += comb(projections, k) * miss ** k * (1 - miss) ** (projections - k)
        if reached >= recall:
            return k
    return projections


@lru_cache(8)
def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))


def _prepared(vectors: DataFrame, width: float, seed: int) -> DataFrame:
    """vec_id, key (null if the vector links with nothing), label, dim, vector (doubles), projections (doubles), cells."""
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for values, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                row = (None,) * 6
                if label is not None and values and None not in values:
                    v = np.array(values, np.float64) + 0.0  # minus zero is zero
                    top = float(np.abs(v).max())
                    if 0 < top < np.inf:  # neither zero nor non-finite (nan compares false)
                        key = hashlib.sha256(label.to_bytes(8, "little", signed=True) + v.tobytes()).digest()[:16]
                        # By a power of two to components of at most 1: squares neither vanish nor overflow, cosines stay the same.
                        v = np.ldexp(v, -int(np.frexp(top)[1]))
                        at = (v / sqrt(float(v @ v))) @ directions(len(v), seed)
                        row = (key, label, len(v), v.tobytes(), at.tobytes(), np.floor(at[:SORTED] / width).astype(int).tolist())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), *[pa.array(x, t) for x, t in zip(out, kinds)]],
                ["vec_id", "key", "label", "dim", "vector", "projections", "cell"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, key binary, label long, dim int, vector binary, projections binary, cell array<int>")


def _dealt(classes: DataFrame, work: Handoff) -> DataFrame:
    """Rows (label, dim, cell, block, query, id, n, vector, projections): every query once in its own cell, and
    every candidate in its own and the neighbouring cells, in each block of queries there."""
    place = ["label", "dim", "cell"]
    sizes = work.write(classes.groupBy(*place).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
    load = ["id", "n", "vector", "projections"]
    queries = classes.join(sizes, place).select(
        *place, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("query"), *load)
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in product((-1, 0, 1), repeat=SORTED)])
    near = classes.withColumn("step", F.explode(steps)).withColumn(
        "cell", F.zip_with("cell", "step", lambda a, b: a + b))
    candidates = near.join(sizes, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return queries.unionByName(candidates.select(*place, "block", F.lit(False).alias("query"), *load))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges to the smallest node of each component of the links a - b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return np.stack([nodes[low], nodes], 1)[low != np.arange(len(nodes))]


def _counted(dealt: DataFrame, cosine: float, misses: int, wide: float, narrow: float) -> DataFrame:
    """(a, b, links): links found by query a (b null), and edges a - b (links null) that keep the components."""
    def pairs(q, c):
        """Indices of pairs whose windows collide often enough."""
        order = np.argsort(c["at"][:, 0], kind="stable")  # a query's window is a run of the sorted projection
        first = c["at"][order, 0]
        lo = np.searchsorted(first, q["at"][:, 0] - wide)
        size = np.searchsorted(first, q["at"][:, 0] + wide, side="right") - lo
        i = np.repeat(np.arange(len(size)), size)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
        for k in range(1, SORTED):
            go = np.abs(q["at"][i, k] - c["at"][j, k]) <= wide
            i, j = i[go], j[go]
        missed = np.zeros(len(i), np.int8)
        for k in range(SORTED, PROJECTIONS):
            missed += np.abs(q["at"][i, k] - c["at"][j, k]) > narrow
            go = missed <= misses
            i, j, missed = i[go], j[go], missed[go]
        return i, j

    def block(rows):
        dim = rows.column("dim")[0].as_py()
        flat = lambda name, n: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.float64).reshape(-1, n)
        v = flat("vector", dim)
        return {"id": rows.column("id").to_numpy(), "n": rows.column("n").to_numpy(), "v": v,
                "at": flat("projections", PROJECTIONS), "norm": np.sqrt((v * v).sum(1))}

    def run(batches):
        place, held, links, tree = None, [], None, np.zeros((0, 2), np.int64)
        names = ("label", "dim", "c", "block")

        def finish():
            if links is not None:
                own = np.flatnonzero(links)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([query["id"][own], tree[:, 0]])),
                     pa.array(np.concatenate([np.zeros(n, np.int64), tree[:, 1]]), mask=np.arange(n + len(tree)) < n),
                     pa.array(np.concatenate([links[own], np.zeros(len(tree), np.int64)]), mask=np.arange(n + len(tree)) >= n)],
                    ["a", "b", "links"])

        query = None
        for batch in batches:
            marks = list(zip(*[batch.column(c).to_pylist() for c in names], batch.column("query").to_pylist()))
            cuts = [0, *[k for k in range(1, len(marks)) if marks[k] != marks[k - 1]], len(marks)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if marks[i][:4] != place:
                    yield from finish()
                    place, held, query, links, tree = marks[i][:4], [], None, None, np.zeros((0, 2), np.int64)
                rows = batch.slice(i, j - i)
                if marks[i][4]:
                    held.append(rows)
                    continue
                if query is None:
                    query = block(pa.Table.from_batches(held).combine_chunks())
                    links, held = np.zeros(len(query["id"]), np.int64), []
                for k in range(0, rows.num_rows, BATCH):
                    part = block(rows.slice(k, BATCH))
                    x, y = pairs(query, part)
                    for s in range(0, len(x), 1 << 17):
                        a, b = x[s:s + (1 << 17)], y[s:s + (1 << 17)]
                        cos = (query["v"][a] * part["v"][b]).sum(1) / (query["norm"][a] * part["norm"][b])
                        go = (cos >= cosine) & (query["id"][a] != part["id"][b])
                        a, b = a[go], b[go]
                        np.add.at(links, a, part["n"][b])
                        if len(a):
                            tree = _forest(*np.concatenate([tree, np.stack([query["id"][a], part["id"][b]], 1)]).T)
        yield from finish()

    keys = ["label", "dim", "c", "block"]
    rows = dealt.withColumn("c", F.concat_ws(",", F.col("cell").cast("array<string>"))).drop("cell")
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("query"), "id").mapInArrow(
        run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, work: Handoff, *, cosine: float = 0.98, recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels and dimensions are equal and their cosine, in double
    precision, is at least ``cosine``; none below it link, and a pair is found with probability ``recall`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    link with nothing and are components of their own. Equal vectors are linked with each other, repeated rows too.
    A null vec_id counts as a link of others and is never the smallest. An empty table gives no rows.
    """
    deviation = sqrt(2 - 2 * cosine)
    wide, narrow = SORTED_DEVIATIONS * deviation, DEVIATIONS * deviation
    rows = work.write(_prepared(vectors, wide, seed), "vectors")
    known = rows.where("key is not null")
    classes = known.groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in ("label", "dim", "vector", "projections", "cell")])
    classes = work.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = work.write(_counted(_dealt(classes.drop("key", "low"), work), cosine, calibrate(recall), wide, narrow), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b"), work)
    named = classes.select("id", "key", "low", "n").join(links, "id", "left") \
        .join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    named = work.write(named, "named")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes_done = work.write(named.join(low, "root").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "done")
    linked = known.select("vec_id", "key").join(classes_done, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
