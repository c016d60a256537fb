"""Explanations.

A row stays one row: its features are an array of (feature, value, ...) structs
built from the wide columns, and the scaler's statistics are numbers, fetched as the one row
that they are. Scaling, Shapley values, margin and score are expressions on that row, and
a ranking of its features is a sort of the array: no join and no shuffle.
The long form, one row per feature, is an ``inline`` at the end. The exact values of forests are in ``trees``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scaler_stats(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """feature -> (mean, population std) of ``train``, nulls left out; a feature without values is constant."""
    row = train.agg(*[x for f in features for x in (F.avg(f).alias("m_" + f), F.stddev_pop(f).alias("s_" + f))]).first()
    return {f: (row["m_" + f] or 0.0, row["s_" + f] or 0.0) for f in features}


# M2
def standard_scale(df: DataFrame, features: list[str], stats: dict, out: str = "scaled") -> DataFrame:
    """``df`` with ``out``: an array of (feature, value, scaled); a constant feature (std 0) scales to 0."""
    def one(f):
        mean, std = stats[f]
        return F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                        ((F.col(f) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)).alias("scaled"))
    return df.withColumn(out, F.array(*[one(f) for f in features]))


def background_means(background: DataFrame, features: list[str], stats: dict) -> dict[str, float]:
    """feature -> mean of the scaled background: the scaling is linear, so it is the scaled mean (0 for the scaler's own rows)."""
    means = scaler_stats(background, features)
    return {f: (means[f][0] - stats[f][0]) / stats[f][1] if stats[f][1] else 0.0 for f in features}


# M13
def linear_shap(scaled: DataFrame, features: list[str], coefs: dict, background: dict, intercept: float,
                column: str = "scaled") -> DataFrame:
    """``scaled`` rows with phi (array of (feature, scaled, phi)), margin, base_value and score.

    phi = coef * (scaled - background mean); score = sigmoid(margin).
    """
    at = {f: F.col(column)[i]["scaled"] for i, f in enumerate(features)}
    phi = F.array(*[F.struct(F.lit(f).alias("feature"), at[f].alias("scaled"),
                             (F.lit(float(coefs[f])) * (at[f] - F.lit(background[f]))).alias("phi")) for f in features])
    start = F.lit(float(intercept))
    margin = reduce(lambda x, f: x + F.lit(float(coefs[f])) * at[f], features, start)
    base = sum((float(coefs[f]) * background[f] for f in features), float(intercept))
    out = scaled.withColumns({"phi": phi, "margin": margin, "base_value": F.lit(base)})
    return out.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("margin"))))


def unpivoted(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """One row per entry of an array of structs."""
    return df.select(*keep, F.inline(column))


# A21
def global_importance(shap: DataFrame, features: list[str]) -> DataFrame:
    """Mean |phi| per feature, ranked: one aggregate row, its entries sorted."""
    wide = shap.agg(*[F.avg(F.abs(F.col("phi")[i]["phi"])).alias(f) for i, f in enumerate(features)])
    entries = F.array(*[F.struct((-F.col(f)).alias("low"), F.lit(f).alias("feature"), F.col(f).alias("mean_abs_phi")) for f in features])
    return wide.select(F.posexplode(F.array_sort(entries)).alias("i", "e")).select(
        "e.feature", "e.mean_abs_phi", (F.col("i") + 1).alias("rank"))


# A22
def shap_by_class(shap: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Mean phi per feature and class, gap and direction; nothing unless both classes are there."""
    def mean(i, c):
        return F.avg(F.when(F.col(label) == c, F.col("phi")[i]["phi"]))
    wide = shap.agg(F.max((F.col(label) == 1).cast("int")).alias("_has1"), F.max((F.col(label) == 0).cast("int")).alias("_has0"),
                    *[mean(i, c).alias(f"{n}_{f}") for i, f in enumerate(features) for c, n in ((1, "v"), (0, "s"))])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("v_" + f).alias("vuln_phi"), F.col("s_" + f).alias("safe_phi"))
                        for f in features])
    gap = F.col("vuln_phi") - F.col("safe_phi")
    return wide.where("_has1 = 1 and _has0 = 1").select(F.inline(entries)).select(
        "feature", "vuln_phi", "safe_phi", gap.alias("gap"), F.when(gap > 0, "up vuln").otherwise("down safe").alias("direction"))


# W9
def outcome(score: str = "score", label: str = "label", threshold: float = 0.5):
    p = F.col(score) >= threshold
    y = F.col(label) == 1
    return (F.when(p & y, "TP").when(p & ~y, "FP").when(~p & ~y, "TN").otherwise("FN"))


def first_per_outcome(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """First row (by ``order``) of each outcome present, with its score; a min per group."""
    first = rows.groupBy(outcome().alias("outcome")).agg(F.min(F.struct(order, "score")).alias("f"))
    return first.select("outcome", f"f.{order}", "f.score")


def _by_size(shap: DataFrame) -> Column:
    """The row's entries by falling |phi|, ties by feature."""
    keyed = F.transform("phi", lambda e: F.struct((-F.abs(e["phi"])).alias("low"), e["feature"].alias("feature"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


# W10
def top_contributors(shap: DataFrame, k: int = 5) -> DataFrame:
    top = shap.select("row_id", F.posexplode(F.slice(_by_size(shap), 1, k)).alias("i", "e"))
    return top.select("row_id", (F.col("i") + 1).alias("pos"), "e.feature", "e.scaled", "e.phi",
                      F.when(F.col("e.phi") > 0, "VULN").otherwise("SAFE").alias("direction"))


# W13
def shap_waterfall(shap: DataFrame) -> DataFrame:
    """Base value, then the running sum of contributions by |phi| descending."""
    steps = shap.select("row_id", "base_value", _by_size(shap).alias("es")).select(
        "row_id", "base_value", "es", F.posexplode("es").alias("i", "e"))
    running = F.aggregate(F.slice("es", F.lit(1), F.col("i") + 1), F.col("base_value"), lambda x, e: x + e["phi"])
    return steps.select("row_id", (F.col("i") + 1).alias("step"), "e.feature", "e.phi", running.alias("value"))


MAX_BACKGROUND = 10_000
#: Predictions that a task makes and groups.
STATES = 1 << 20
#: States that a task holds as a matrix for a scorer of arrays.
HELD_STATES = 1 << 17


# M14
def sampled_shap(rows: DataFrame, features: list[str], background: DataFrame, predict, n_perm: int = 16,
                 seed: int = 42, id_col: str = "row_id", scorer=None) -> DataFrame:
    """Model-agnostic Shapley values by permutation sampling (Monte Carlo).

    Each explained row gets ``n_perm`` samples; sample p draws a feature
    permutation (a seeded hash order) and one background row (a seeded hash
    of (row, p) modulo the background size).  Features placed before j in
    the permutation come from the row, the rest from the background row;
    phi_j averages the gain of switching feature j to the row's value.
    No all-pairs product: each sample is an equi-join to one background row.
    Work is linear in ``rows``. ``background`` is a sample of at most ``MAX_BACKGROUND`` rows, which is
    checked; ``predict(df)`` returns df with a ``prob`` column.  Returns (row_id, feature, phi).
    ``scorer``: the same model as a function of a (rows, features) array of doubles, nulls as 0. With it a row's
    states are built, scored and averaged in Arrow batches, so that none becomes a row.
    """
    spark = rows.sparkSession
    bg = background.select(*[F.col(f).alias("bg_" + f) for f in features])
    bg = bg.withColumn("_bk", F.md5(F.concat_ws(":", *[F.col("bg_" + f).cast("string") for f in features])))
    bg = bg.withColumn("bg_idx", F.row_number().over(Window.orderBy("_bk")) - 1).drop("_bk")   # capped rows
    n_bg = bg.count()
    if not 0 < n_bg <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows, not {n_bg}")
    perms = spark.range(n_perm).withColumnRenamed("id", "perm")
    keyed = F.transform(F.array(*[F.lit(f) for f in features]),
                        lambda f: F.struct(F.md5(F.concat(f, F.lit(":"), F.col("perm").cast("string"),
                                                          F.lit(f":{seed}"))).alias("k"), f.alias("f")))
    plan = perms.select("perm", F.transform(F.array_sort(keyed), lambda x: x["f"]).alias("order"))
    # A row's states stay with it: dealt out by id, neither grouping shuffles them.
    own = rows.select(id_col, *features)
    tasks = max(1, -(-own.count() * n_perm * (len(features) + 1) // STATES))
    if scorer is not None:
        orders = [r["order"] for r in plan.orderBy("perm").collect()]
        known = bg.orderBy("bg_idx").select(*[F.coalesce(F.col("bg_" + f).cast("double"), F.lit(0.0)) for f in features]).collect()
        return _sampled_by_arrays(own.repartition(tasks, id_col), features, np.array(known, float), orders, scorer, seed, id_col)
    samples = (own.repartition(tasks, id_col).select(id_col, *features, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
               .withColumn("bg_idx", F.pmod(F.xxhash64(F.col(id_col), F.col("perm"), F.lit(seed)), F.lit(n_bg)))
               .join(F.broadcast(plan), "perm")          # n_perm rows
               .join(F.broadcast(bg), "bg_idx"))         # capped background
    # State k takes the first k features of the order from the row: one prediction per state, and a
    # feature's gain is the difference of two neighbouring states, so gains add up exactly.
    states = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = states.select(id_col, "perm", "k", "order", *[
        F.when(F.array_position("order", F.lit(f)) <= F.col("k"), F.col(f)).otherwise(F.col("bg_" + f)).alias(f) for f in features])
    probs = predict(mixed).groupBy(id_col, "perm").agg(
        F.first("order").alias("order"), F.array_sort(F.collect_list(F.struct("k", "prob"))).alias("p"))
    gains = probs.select(id_col, F.posexplode("order").alias("j", "feature"), "p")
    gain = F.get("p", F.col("j") + 1)["prob"] - F.get("p", F.col("j"))["prob"]
    return gains.groupBy(id_col, "feature").agg(F.avg(gain).alias("phi"))


def _sampled_by_arrays(rows: DataFrame, features: list[str], background: np.ndarray, orders: list, scorer, seed: int, id_col: str) -> DataFrame:
    """``sampled_shap`` of the same samples, a batch of rows at a time."""
    width, n_perm = len(features), len(orders)
    place = np.array([[order.index(f) for f in features] for order in orders])            # sample, feature: from 0
    own = place[:, None, :] < np.arange(width + 1)[None, :, None]                         # sample, state, feature: the row's value
    step = max(1, HELD_STATES // (n_perm * (width + 1)))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 1, 1, width)
                at = part.column("_bg").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_perm)
                states = np.where(own, x, background[at][:, :, None, :])
                gain = np.diff(scorer(states.reshape(-1, width)).reshape(-1, n_perm, width + 1), axis=2)
                phi = np.take_along_axis(gain, np.broadcast_to(place, (len(x), n_perm, width)), axis=2).mean(axis=1)
                ends = pa.array(np.arange(0, phi.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], [id_col, "_phi"])

    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_perm - 1)), lambda p: F.pmod(F.xxhash64(F.col(id_col), p, F.lit(seed)), F.lit(len(background))))
    given = rows.select(id_col, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("_x"), drawn.alias("_bg"))
    schema = StructType([given.schema.fields[0], *StructType.fromDDL("_phi array<double>").fields])
    wide = given.mapInArrow(run, schema).groupBy(id_col).agg(*[F.avg(F.col("_phi")[i]).alias(f"_phi{i}") for i in range(width)])
    return wide.select(id_col, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_phi{i}").alias("phi")) for i, f in enumerate(features)])))
