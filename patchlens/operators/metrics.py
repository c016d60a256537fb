"""Evaluation of scored rows.

Input: rows with a 0/1 ``label`` and a ``score`` (probability of label 1).

Threshold-free metrics (ROC AUC with ties counted half, step-wise average
precision, the PR curve, the F1-optimal threshold) need, for every distinct
score s, the positives and negatives scored >= s.  That is a prefix sum over
the distinct scores in descending order, computed without a global window:

1. aggregate rows to one row per distinct score (map-side combined), stored;
2. deal the distinct scores out by ranges, as many as their number asks for at ``RANGE_ROWS`` each;
3. total each range, prefix-sum the totals (a row per range);
4. prefix-sum inside each range, partitioned by range, and add the range's offset.

The results are exact whatever the ranges are. Group totals come from the range totals too, so
no step gathers a group's scores. Confusion counts at a threshold are sums over the distinct scores as well, so
the scored rows are read once. A group with one class only has no ROC AUC (null);
without positives its average precision is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.session import materialize

#: Distinct scores of a range: a task sorts and sums one.
RANGE_ROWS = 1 << 20


def _pos(label: str) -> Column:
    return F.when(F.col(label) == 1, 1).otherwise(0)


def _neg(label: str) -> Column:
    return F.when(F.col(label) == 1, 0).otherwise(1)


# A13 / A14
def confusion_counts(df: DataFrame, threshold, score: str = "score", label: str = "label",
                     pred: Column | None = None) -> DataFrame:
    """TP FP FN TN at ``score >= threshold`` (or a given prediction column)."""
    p = pred if pred is not None else (F.col(score) >= threshold)
    y = F.col(label) == 1
    return df.agg(F.sum(F.when(p & y, 1).otherwise(0)).cast("long").alias("tp"),
                  F.sum(F.when(p & ~y, 1).otherwise(0)).cast("long").alias("fp"),
                  F.sum(F.when(~p & y, 1).otherwise(0)).cast("long").alias("fn"),
                  F.sum(F.when(~p & ~y, 1).otherwise(0)).cast("long").alias("tn"))


def prf_columns(tp="tp", fp="fp", fn="fn") -> list[Column]:
    """Positive-class precision, recall, F1; 0 on a zero division."""
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    p = F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    f1 = F.when(2 * tp + fp + fn == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def precision_recall_f1(df: DataFrame, threshold, score="score", label="label") -> DataFrame:
    cc = confusion_counts(df, threshold, score, label)
    return cc.select("tp", "fp", "fn", "tn", *prf_columns())


# prefix sums over distinct scores
def score_counts(df: DataFrame, score: str = "score", label: str = "label", by: list[str] = (), pred: Column | None = None) -> DataFrame:
    """Rows of either class per distinct score; with ``pred`` also those where it holds and doesn't hold (_tp, _fp, _fn, _tn)."""
    hits = [] if pred is None else [F.sum(F.when(p, n).otherwise(0)).cast("long").alias(name) for name, p, n in (
        ("_tp", pred, _pos(label)), ("_fp", pred, _neg(label)), ("_fn", ~pred, _pos(label)), ("_tn", ~pred, _neg(label)))]
    return (df.groupBy(*by, F.col(score).alias("s"))
            .agg(F.sum(_pos(label)).cast("long").alias("pos"), F.sum(_neg(label)).cast("long").alias("neg"), *hits))


def stored_counts(df: DataFrame, score: str = "score", label: str = "label", by: list[str] = (), pred: Column | None = None) -> DataFrame:
    """``score_counts`` as a table, all one range: what follows reads it several times, and its row count is in its footers."""
    return materialize(score_counts(df, score, label, by, pred).withColumn("_b", F.lit(0)))


def ranged(counts: DataFrame, range_rows: int = RANGE_ROWS, by: list[str] = ()) -> DataFrame:
    """Stored ``counts`` with ``_b``: the number of the range, rising from group to group and with falling scores."""
    parts = -(-counts.count() // range_rows)
    if parts <= 1:
        return counts
    # Stored, so that totals and rows come from the same ranges.
    return materialize(counts.repartitionByRange(parts, *by, F.col("s").desc()).withColumn("_b", F.spark_partition_id()))


def cumulative_desc(counts: DataFrame, range_rows: int = RANGE_ROWS, by: list[str] = ()) -> DataFrame:
    """Per (group, distinct score s) of stored counts: pos, neg, tp = positives scored >= s, fp likewise, P and N of the group."""
    by = list(by)
    rows = ranged(counts, range_rows, by)
    totals = rows.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    group = Window.partitionBy(*by)                       # a row per range
    above = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias("_o_" + c) for c in by], F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
                            F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
                            F.sum("_bp").over(group).alias("P"), F.sum("_bn").over(group).alias("N"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("_b") == F.col("_ob")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col("_o_" + c))
    j = rows.join(offsets, cond)
    return j.select(*by, "s", "pos", "neg",
                    (F.sum("pos").over(inside) + F.col("_op")).cast("long").alias("tp"),
                    (F.sum("neg").over(inside) + F.col("_on")).cast("long").alias("fp"), "P", "N")


def _ranking(cum: DataFrame, by: list[str] = ()) -> DataFrame:
    auc_term = F.col("pos") * (F.col("N") - F.col("fp") + 0.5 * F.col("neg"))
    ap_term = F.when(F.col("P") > 0, (F.col("pos") / F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")))).otherwise(0.0)
    pairs = F.max(F.col("P") * F.col("N"))
    return cum.groupBy(*by).agg(F.when(pairs > 0, F.sum(auc_term) / pairs).alias("auc"), F.sum(ap_term).alias("prauc"))


# A15 / A16
def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label",
                    range_rows: int = RANGE_ROWS, by: list[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision, per group.

    Null with one class only (AUC); 0 without positives (average precision).
    """
    return _ranking(cumulative_desc(stored_counts(df, score, label, by), range_rows, by), list(by))


def _curve(cum: DataFrame) -> DataFrame:
    P = F.col("P")
    pts = cum.select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     F.when(P == 0, F.lit(1.0)).otherwise(F.col("tp") / P).alias("recall"))
    end = cum.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# A17
def pr_curve(df: DataFrame, score: str = "score", label: str = "label",
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """Precision and recall at every distinct threshold, plus the (1, 0) end point."""
    return _curve(cumulative_desc(stored_counts(df, score, label), range_rows))


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _best(curve: DataFrame, default: float) -> DataFrame:
    scored = curve.select(F.coalesce("threshold", F.lit(default)).alias("threshold"),
                          f1_of(F.col("precision"), F.col("recall")).alias("f1"),
                          F.col("threshold").isNull().alias("_end"))
    return scored.orderBy(F.col("f1").desc(), F.col("_end").asc(), F.col("threshold").asc()) \
                 .limit(1).drop("_end")


# A18
def best_threshold(df: DataFrame, score: str = "score", label: str = "label",
                   range_rows: int = RANGE_ROWS, default: float = 0.5) -> DataFrame:
    """Threshold with the highest F1 on the PR curve; ties -> lowest threshold."""
    return _best(pr_curve(df, score, label, range_rows), default)


def _joined(cc: DataFrame, ranking: DataFrame, keys: list[str]) -> DataFrame:
    rk = ranking.withColumnsRenamed({k: "_r_" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_r_" + k))
    return cc.join(rk, same).select(*keys, "threshold", "tp", "fp", "fn", "tn", *prf_columns(), "auc", "prauc")


def _confusion(rows: DataFrame, keys: list[str], t: Column, p: Column, pos: Column, neg: Column) -> DataFrame:
    def total(hit, n):
        return F.sum(F.when(hit, n).otherwise(0)).cast("long")
    return rows.groupBy(*keys).agg(F.max(t.cast("double")).alias("threshold"), total(p, pos).alias("tp"), total(p, neg).alias("fp"),
                                   total(~p, pos).alias("fn"), total(~p, neg).alias("tn"))


# A19
def grouped_metrics(scores: DataFrame, by=(), threshold=0.5, score: str = "score",
                    label: str = "label", pred: Column | None = None) -> DataFrame:
    """Per group: threshold, confusion counts, P/R/F1, ROC AUC and AP.

    A row counts as positive at ``score >= threshold`` (a number or a scalar
    Column), or where ``pred`` holds if that is given. A null group is a group. The rows, which a model may have to score, are read once.
    """
    by = list(by)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    keys = by or ["_g"]
    rows = scores if by else scores.withColumn("_g", F.lit(1))
    counts = stored_counts(rows, score, label, keys, pred)
    if pred is None:
        cc = _confusion(counts, keys, t, F.col("s") >= t, F.col("pos"), F.col("neg"))
    else:
        cc = counts.groupBy(*keys).agg(F.max(t.cast("double")).alias("threshold"), *[F.sum("_" + c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return _joined(cc, _ranking(cumulative_desc(counts, by=keys), keys), keys).select(*by, "threshold", "tp", "fp", "fn", "tn",
                                                                                     "precision", "recall", "f1", "auc", "prauc")


def metrics_at_thresholds(df: DataFrame, score="score", label="label", tune_on: DataFrame | None = None,
                          default: float = 0.5) -> DataFrame:
    """Metric rows at the default threshold and at the F1-tuned threshold.

    The threshold is tuned on ``tune_on`` (a validation frame) when given,
    else on ``df`` itself. The rows are read once: both confusions and the ranking come from the counts by score.
    """
    counts = stored_counts(df.withColumn("_g", F.lit(1)), score, label, ["_g"])
    cum = cumulative_desc(counts, by=["_g"])
    curve = _curve(cum.drop("_g")) if tune_on is None else pr_curve(tune_on, score, label)
    tuned = _best(curve, default).first()["threshold"]     # one row
    ranking = _ranking(cum, ["_g"])
    out = [_joined(_confusion(counts, ["_g"], F.lit(float(t)), F.col("s") >= t, F.col("pos"), F.col("neg")), ranking, ["_g"])
           .drop("_g").select(F.lit(kind).alias("kind"), "*") for kind, t in (("default", default), ("tuned", tuned))]
    return out[0].unionByName(out[1])


# A20
def fold_f1(df: DataFrame, threshold: float = 0.5, fold: str = "fold", score="score", label="label") -> DataFrame:
    p = F.col(score) >= threshold
    y = F.col(label) == 1
    per = df.groupBy(fold).agg(F.sum(F.when(p & y, 1).otherwise(0)).alias("tp"),
                               F.sum(F.when(p & ~y, 1).otherwise(0)).alias("fp"),
                               F.sum(F.when(~p & y, 1).otherwise(0)).alias("fn"))
    return per.select(fold, *prf_columns())


def cv_summary(folds: DataFrame, test_f1=None) -> DataFrame:
    """Mean and population std of fold F1; gap = mean - test F1."""
    out = folds.agg(F.avg("f1").alias("cv_mean"), F.stddev_pop("f1").alias("cv_std"),
                    F.count(F.lit(1)).alias("n_folds"))
    if test_f1 is not None:
        out = out.select("*", F.lit(test_f1).alias("test_f1"), (F.col("cv_mean") - test_f1).alias("gap"))
    return out


# M3
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per label: count, balanced weight n/(2 n_c), ratio weight (1 safe, safe/max(vuln,1) vuln)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"),
                 F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"))
    n, n0, n1 = tot.select("n").scalar(), tot.select("n0").scalar(), tot.select("n1").scalar()
    return counts.select(label, F.col("n_c").cast("long").alias("n_c"),
                         (n / (2 * F.col("n_c"))).alias("balanced_weight"),
                         F.when(F.col(label) == 1, n0 / F.greatest(n1, F.lit(1))).otherwise(F.lit(1.0))
                         .cast("double").alias("ratio_weight"))


def with_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight of each row's class (a weightCol)."""
    tot = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"))
    n, n1 = tot.select("n").scalar(), tot.select("n1").scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, n / (2.0 * n1)).otherwise(n / (2.0 * (n - n1))))
