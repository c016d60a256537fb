"""Centroid clustering over bit planes.

A vector of 64 integers is stored as one unsigned 64-bit word for each bit of its components (two's
complement): bit i of plane b is bit b of component i. With the weight 2**b, and -2**b for the
sign plane, the dot product of two vectors is

    sum over planes a, b of weight[a] * weight[b] * popcount(plane_a(u) & plane_b(v)),

exact in integers; distances follow from |u|^2 - 2 u.v + |v|^2. The planes are written once and each round
reads them again; only sums of one row per cluster and task are shuffled, and k rows reach the driver.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff

DIM = 64
SCALE = 1024
#: Components lie below this in size, so that no distance of 64 of them exceeds a long.
LIMIT = 1 << 27
#: Rows that one numpy step works on.
STEP = 1 << 15
_BITS = np.uint64(1) << np.arange(DIM, dtype=np.uint64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(width, n) planes of n x 64 integers; the last plane is the sign's."""
    out = np.empty((width, len(values)), np.uint64)
    for b in range(width):
        out[b] = (((values >> b) & 1).astype(np.uint64) * _BITS).sum(axis=1, dtype=np.uint64)
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    """The n x 64 integers of (width, n) planes."""
    out = np.zeros((planes.shape[1], DIM), np.int64)
    for plane, weight in zip(planes, weights(len(planes))):
        out += ((plane[:, None] & _BITS) != 0) * weight
    return out


def weights(width: int) -> list[int]:
    return [1 << b for b in range(width - 1)] + [-(1 << (width - 1))]


def width_of(low: int, high: int) -> int:
    """Planes that two's complement needs for low..high."""
    return max(int(high).bit_length(), int(~low).bit_length() if low < 0 else 0) + 1


def dots(planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact dot products of n vectors with one, or with n others row by row, from their planes."""
    total = np.zeros(planes.shape[1], np.int64)
    for a, wa in zip(planes, weights(len(planes))):
        part = np.zeros(planes.shape[1], np.int64)
        for b, wb in zip(centre, weights(len(centre))):
            part += np.bitwise_count(a & b).astype(np.int64) * wb
        total += part * wa
    return total


def nearest(planes: np.ndarray, norms: np.ndarray, centres: list[list[int]]):
    """(number of the nearest centroid, squared distance); ties: the smaller number."""
    best = np.full(planes.shape[1], np.iinfo(np.int64).max)
    which = np.zeros(planes.shape[1], np.int32)
    for k, centre in enumerate(centres):
        c = np.array([centre], np.int64)
        packed = pack(c, width_of(int(c.min()), int(c.max())))[:, 0]
        d = norms - 2 * dots(planes, packed) + sum(x * x for x in centre)
        closer = d < best
        best[closer], which[closer] = d[closer], k
    return which, best


def usable(vector: str = "embedding") -> Column:
    """64 components, none null, non-finite or of a size of LIMIT / 1024 or more."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == DIM) & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float(LIMIT // SCALE))))


def _planes_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("planes").flatten().to_numpy().view(np.uint64)
    return np.ascontiguousarray(flat.reshape(-1, width).T)


def bit_planes(vectors: DataFrame, work: Handoff, vector_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, planes array<long>, norm) of every usable vector as a stored table, and the number of planes."""
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where(usable(vector)).select(F.col(vector_id).cast("long").alias("vec_id"), ints.alias("v"))
    ends = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width = width_of(ends[0], ends[1]) if ends[0] is not None else 1

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                planes = pack(part.column("v").flatten().to_numpy().reshape(-1, DIM), width)
                flat = pa.array(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists, pa.array(dots(planes, planes))],
                                                 ["vec_id", "planes", "norm"])

    return work.write(rows.mapInArrow(run, "vec_id long, planes array<long>, norm long"), "planes"), width


def _first_centres(table: DataFrame, width: int, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest sha256 of "seed:vec_id"; ties (repeated ids): by their planes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.where("vec_id is not null").select(key.alias("key"), "planes").orderBy("key", "planes").limit(k).collect()
    return [unpack(np.array(r["planes"], np.int64).view(np.uint64)[:, None])[0].tolist() for r in rows]


def _sums(table: DataFrame, width: int, centres: list[list[int]]) -> list:
    """(cluster, i, n, t): size and exact sum of component i of every non-empty cluster; k x 64 rows."""
    def run(batches):
        count = np.zeros(len(centres), np.int64)
        total = np.zeros((len(centres), DIM), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                planes = _planes_of(part, width)
                which, _ = nearest(planes, part.column("norm").to_numpy(), centres)
                values = unpack(planes)
                for k in np.unique(which):
                    mine = which == k
                    count[k] += int(mine.sum())
                    total[k] += values[mine].sum(axis=0)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]),
                                          pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "t"))
    return each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()


def _assigned(table: DataFrame, width: int, centres: list[list[int]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                which, best = nearest(_planes_of(part, width), part.column("norm").to_numpy(), centres)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(which), pa.array(best)],
                                                 ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroids(table: DataFrame, width: int, k: int, rounds: int, seed: int) -> list[list[int]]:
    """The centroids after ``rounds``, or earlier if a round leaves all as they were (later ones would too)."""
    centres = _first_centres(table, width, k, seed)
    for _ in range(rounds if centres else 0):
        before = [list(c) for c in centres]
        for row in _sums(table, width, centres):
            centres[row["cluster"]][row["i"]] = int(row["t"]) // row["n"]
        if centres == before:
            break
    return centres


def cluster(vectors: DataFrame, work: Handoff, *, k: int = 8, rounds: int = 10, seed: int = 3,
            vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (64 integers) of every vector kept.

    Kept: vectors of exactly 64 components, none null, non-finite or of a size of 131,072 or more (whose
    distances no long could hold); a component x becomes floor(1024 * x). Repeated rows are vectors of their own. A null id
    is kept but starts no centroid; without any other id there is no centroid and the result is empty, as it is for an empty
    table. Fewer than k vectors make as many centroids. Ties go to the smaller number; empty clusters keep their centroid.
    Other columns are not read.
    """
    table, width = bit_planes(vectors, work, vector_id, vector)
    centres = centroids(table, width, k, rounds, seed)
    rows = _assigned(table.where(F.lit(bool(centres))), width, centres)
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per = F.element_at(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centres))] or [F.lit(0).cast("long")]), F.col("cluster") + 1)
    lists = F.array(*[F.array(*map(F.lit, map(int, c))).cast("array<long>") for c in centres] or [F.array().cast("array<long>")])
    return rows.select("vec_id", "cluster", "distance", per.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                       F.element_at(lists, F.col("cluster") + 1).alias("centroid"))
