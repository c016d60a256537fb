"""Exact Shapley values of a fitted forest (M14), path by path.

A leaf is a box: on each feature of its path an interval, and a share of the training weight that stays on
the path when the feature is unknown (the product of the children's shares at the splits on it). For one row
the leaf is a game in which a known feature contributes 1 or 0 (the row is inside the interval or not) and an
unknown one its share; the forest's values are the sums of its leaves' games, by linearity. In the game of one leaf

    phi_i = value * (inside_i - share_i) * sum over k of k! (m-1-k)! / m! * q_k,

where q_k is the sum over all sets of k other features of the products of what they contribute. These sums are the
coefficients of prod(share_j + inside_j * t), which is extended by one feature after the other; taking
a feature out again is one division by its factor. No feature set is enumerated and nothing is sampled.

A leaf sees at most 2**m patterns of inside or outside, m being the number of different features on its path, so a batch of rows is
answered from a table of those patterns, or row by row where the table would be longer than the batch.

The trees take their thresholds from a few per feature (the bins of the fit), so they tell rows apart by cells only: for each feature, the
number of the forest's thresholds below the value. Rows can be dealt out by ranges of their cells (and ids, so that a large cell is no single
task's), and an Arrow batch explains each of its cells once, by lists of leaf bits for each value of a cell's coordinates.
The trees go to the executors in parts of at most ``PART_BYTES`` each.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.session import scratch_path

#: Bytes of leaf arrays that one broadcast may hold, and entries of a numpy step.
PART_BYTES = 64 << 20
STEP = 1 << 22
#: Rows that a task explains.
TASK_ROWS = 1 << 16


@dataclass
class Leaves:
    """One tree: row l of each array is a leaf, column s a feature of its path (padded with a feature that decides nothing)."""
    feature: np.ndarray   # its number; the number of features for padding
    low: np.ndarray       # inside: low < x <= high
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray     # P(label = 1) in the leaf, over the number of trees

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.feature, self.low, self.high, self.share, self.value))

    @property
    def expected(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())


def leaves_of(nodes: dict, n_features: int, n_trees: int) -> Leaves:
    """``nodes``: id -> (left, right, feature, threshold, class weights); left is -1 in a leaf; the root is node 0."""
    out = []

    def walk(i, path):
        left, right, feature, threshold, weights = nodes[i]
        if left < 0:
            out.append((path, weights[1] / sum(weights) / n_trees))
            return
        for child, is_left in ((left, True), (right, False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            share *= sum(nodes[child][4]) / sum(weights)
            bounds = (low, min(high, threshold), share) if is_left else (max(low, threshold), high, share)
            walk(child, {**path, feature: bounds})

    walk(0, {})
    m = max(1, *(len(path) for path, _ in out))
    shape = (len(out), m)
    tree = Leaves(np.full(shape, n_features), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in out]))
    for row, (path, _) in enumerate(out):
        for slot, (feature, (low, high, share)) in enumerate(sorted(path.items())):
            tree.feature[row, slot], tree.low[row, slot], tree.high[row, slot], tree.share[row, slot] = feature, low, high, share
    return tree


def forest_leaves(model, spark) -> list[Leaves]:
    """The trees of a fitted random forest classifier with two classes, from its saved nodes.

    The nodes are as many as the model on the driver has. Only splits at a threshold are known here, which is all that numeric features give.
    """
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    trees: dict[int, dict] = {}
    for r in data.select("treeID", "nodeData.*").toLocalIterator():
        if r["split"]["featureIndex"] >= 0 and r["split"]["numCategories"] != -1:
            raise ValueError("the forest splits on categories")
        cut = r["split"]["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (
            r["leftChild"], r["rightChild"], r["split"]["featureIndex"], cut[0] if cut else 0.0, tuple(r["impurityStats"]))
    return [leaves_of(trees[t], model.numFeatures, len(trees)) for t in sorted(trees)]


def game_values(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(inside_i - share_i) * weighted sum of the other features' products; features are the last axis of both arrays."""
    inside, share = np.broadcast_arrays(inside.astype(float), share)
    m = inside.shape[-1]
    e = [np.ones(inside.shape[:-1])] + [np.zeros(inside.shape[:-1]) for _ in range(m)]
    for j in range(m):
        one, zero = inside[..., j], share[..., j]
        for k in range(j + 1, 0, -1):
            e[k] = zero * e[k] + one * e[k - 1]
        e[0] = zero * e[0]
    weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    out = np.empty(inside.shape)
    for i in range(m):
        one, zero = inside[..., i], share[..., i]
        # Divided by (share + t): from the highest power down; divided by the share alone: each power on its own.
        q = e[m]
        known = weight[m - 1] * q
        for k in range(m - 1, 0, -1):
            q = e[k] - zero * q
            known = known + weight[k - 1] * q
        unknown = sum(weight[k] * e[k] for k in range(m)) / zero
        out[..., i] = (one - zero) * np.where(one > 0, known, unknown)
    return out


def _spread(values: np.ndarray, feature: np.ndarray, width: int) -> np.ndarray:
    """(leaf, pattern, slot) values as (leaf, pattern, feature)."""
    out = np.zeros((*values.shape[:2], width))
    for s in range(values.shape[2]):
        out[np.arange(len(values)), :, feature[:, s]] += values[:, :, s]
    return out


def cuts_of(trees: list[Leaves], width: int) -> list[np.ndarray]:
    """For each feature the forest's thresholds, rising."""
    return [np.unique(np.concatenate([x[(t.feature == f) & np.isfinite(x)] for t in trees for x in (t.low, t.high)])) for f in range(width)]


def cells(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """(row, feature): thresholds below the value; a value that isn't a number is above all, as in the forest."""
    return np.stack([np.searchsorted(c, np.where(np.isnan(v), np.inf, v), side="left") for c, v in zip(cuts, x.T)], axis=1)


def explain(trees: list[Leaves], x: np.ndarray) -> np.ndarray:
    """Shapley values (row, feature) of the rows ``x``; a value that isn't a number goes right, as in the forest."""
    cuts = cuts_of(trees, x.shape[1])
    at, of = np.unique(cells(cuts, x), axis=0, return_inverse=True)
    return _explain_cells(trees, cuts, at)[of.reshape(-1)]


def _explain_cells(trees: list[Leaves], cuts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    n, width = at.shape
    out = np.zeros((n, width + 1))
    # A value of each coordinate; the last feature is the padding.
    values = [np.append(c, np.inf) for c in cuts] + [np.zeros(1)]
    for tree in trees:
        m = tree.feature.shape[1]
        bit = 1 << np.arange(m)
        table = (1 << m) <= max(n, 64)
        size = max(1, STEP // ((1 << m) * (width + 1))) if table else 256
        for a in range(0, len(tree.value), size):
            part = slice(a, a + size)
            feature, low, high, share, value = (getattr(tree, c)[part] for c in ("feature", "low", "high", "share", "value"))
            each = np.arange(len(value))
            step = max(1, STEP // (len(value) * (width + 1)))
            if table:
                patterns = (np.arange(1 << m)[:, None] & bit) > 0
                known = _spread(game_values(patterns[None], share[:, None]) * value[:, None, None], feature, width + 1)
                known = known.reshape(-1, width + 1)
                # bits[f][c, l]: the bit of leaf l's slot of feature f, if a value with coordinate c is inside.
                bits = [np.zeros((len(v), len(value)), np.int32) for v in values]
                for s in range(m):
                    for f, v in enumerate(values):
                        l = np.flatnonzero(feature[:, s] == f)
                        bits[f][:, l] += ((v[:, None] > low[l, s]) & (v[:, None] <= high[l, s])) * bit[s].astype(np.int32)
                bits[width][:] += (each << m).astype(np.int32)
                for i in range(0, n, step):
                    rows = at[i:i + step]
                    seen = np.broadcast_to(bits[width], (len(rows), len(value))).copy()
                    for f in range(width):
                        seen += bits[f][rows[:, f]]
                    out[i:i + step] += np.take(known, seen, axis=0).sum(axis=1)
            else:
                x = np.stack([values[f][at[:, f]] for f in range(width)] + [np.zeros(n)], axis=1)
                for i in range(0, n, step):
                    seen = x[i:i + step][:, feature]
                    phi = game_values((seen > low) & (seen <= high), share) * value[:, None]
                    for s in range(m):
                        np.add.at(out[i:i + step].T, feature[:, s], phi[:, :, s].T)
    return out[:, :width]


def _parts(trees: list[Leaves], most: int) -> list[list[Leaves]]:
    parts, size = [[]], 0
    for tree in trees:
        if parts[-1] and size + tree.nbytes > most:
            parts.append([])
            size = 0
        parts[-1].append(tree)
        size += tree.nbytes
    return parts


# M14
def tree_shap(rows: DataFrame, model, features: str = "features", part_bytes: int = PART_BYTES, deal: bool = False) -> DataFrame:
    """``rows`` (any columns and the vector ``features``) with phi (array of doubles in the vector's order) and base_value.

    base_value + sum(phi) is the forest's P(label = 1). The background is the training data as the trees have counted it.
    Trees beyond ``part_bytes`` of leaf arrays are a part of their own; the parts are one step after the other over the same rows.
    ``deal``: rows are dealt out by ranges of their cells first; otherwise there is no shuffle.
    """
    spark = rows.sparkSession
    trees = forest_leaves(model, spark)
    kept = [f for f in rows.schema.fields if f.name != features]
    out = rows.withColumn("__x", vector_to_array(features)).drop(features) \
        .withColumn("phi", F.array_repeat(F.lit(0.0), model.numFeatures))
    if deal:
        # Equal cells side by side, in as many tasks as have rows for them.
        cuts = cuts_of(trees, model.numFeatures)
        cell = [sum((F.col("__x")[i] > float(c)).cast("int") for c in cut) if len(cut) else F.lit(0) for i, cut in enumerate(cuts)]
        order = [F.array(*cell), F.xxhash64(f"`{kept[0].name}`")]
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
        out = out.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    for part in _parts(trees, part_bytes):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column("__x").flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1)
                phi = batch.column("phi").flatten().to_numpy(zero_copy_only=False).reshape(x.shape) + explain(shared.value, x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32)), pa.array(phi.reshape(-1)))
                at = batch.schema.get_field_index("phi")
                yield batch.set_column(at, "phi", lists)

        out = out.mapInArrow(run, out.schema)
    base = sum(tree.expected for tree in trees)
    return out.select(*[F.col(f"`{f.name}`") for f in kept], "phi", F.lit(base).alias("base_value"))
