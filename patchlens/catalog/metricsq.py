"""Evaluation queries over scored rows.

Scored rows: documents x labels, label = toxic, score from the text length
(many ties, both classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.operators import metrics as M
from patchlens.operators import sampling as W
from patchlens.sources.fixtures import scored_rows


def rank_ctes(src: str = "scored_rows", prefix: str = "") -> str:
    p = prefix
    return f"""
{p}counts AS (SELECT score AS s, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                  CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM {src} GROUP BY score),
{p}cum AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {p}counts
        WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM {p}counts),
{p}rank_m AS (SELECT sum(pos * (N - fp + 0.5 * neg)) / (P * N) AS auc,
                   sum((pos / P) * (tp / (tp + fp))) AS prauc FROM {p}cum, {p}tot GROUP BY P, N),
{p}curve AS (SELECT s AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM {p}cum, {p}tot
          UNION ALL SELECT NULL, 1.0, 0.0),
{p}best AS (SELECT coalesce(threshold, 0.5) AS threshold,
                 CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
                 threshold IS NULL AS is_end FROM {p}curve
          ORDER BY f1 DESC, is_end ASC, threshold ASC LIMIT 1)"""


def cc_select(src: str, t: str) -> str:
    return f"""SELECT CAST(sum(CASE WHEN score >= {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN score >= {t} AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN score < {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN score < {t} AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {src}"""


PRF = """CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"""

SR = O.with_(O.SCORED_ROWS, rank_ctes())
PRF_D = ("precision", "recall", "f1")


@register("confusion_counts", O.with_(O.SCORED_ROWS) + cc_select("scored_rows", "0.5"))
def confusion_counts(spark, sf):
    """TP FP FN TN at score >= 0.5."""
    return M.confusion_counts(scored_rows(spark, sf), 0.5)


@register("precision_recall_f1", O.with_(O.SCORED_ROWS) + f"SELECT *, {PRF} FROM ({cc_select('scored_rows', '0.5')}) c",
          doubles=PRF_D)
def precision_recall_f1(spark, sf):
    """Positive-class P / R / F1 at 0.5, 0 on zero division."""
    return M.precision_recall_f1(scored_rows(spark, sf), 0.5)


@register("roc_auc", SR + "SELECT auc FROM rank_m", doubles=("auc",))
def roc_auc(spark, sf):
    """Rank ROC AUC, ties count half."""
    return M.ranking_metrics(scored_rows(spark, sf)).select("auc")


@register("average_precision", SR + "SELECT prauc FROM rank_m", doubles=("prauc",))
def average_precision(spark, sf):
    """Step-wise average precision over distinct scores."""
    return M.ranking_metrics(scored_rows(spark, sf)).select("prauc")


@register("pr_curve", SR + "SELECT threshold, precision, recall FROM curve",
          doubles=("threshold", "precision", "recall"))
def pr_curve(spark, sf):
    """Precision / recall per distinct threshold plus the (1, 0) end point."""
    return M.pr_curve(scored_rows(spark, sf))


@register("best_threshold", SR + "SELECT threshold, f1 FROM best", doubles=("threshold", "f1"))
def best_threshold(spark, sf):
    """F1-optimal threshold, ties to the lowest threshold."""
    return M.best_threshold(scored_rows(spark, sf))


def _at_sql(src: str, t: str, kind: str, rk: str = "rank_m") -> str:
    return (f"SELECT '{kind}' AS kind, CAST({t} AS DOUBLE) AS threshold, tp, fp, fn, tn, {PRF}, "
            f"(SELECT auc FROM {rk}) AS auc, (SELECT prauc FROM {rk}) AS prauc FROM ({cc_select(src, t)}) c")


AT_D = ("threshold", "precision", "recall", "f1", "auc", "prauc")


@register("metrics_at_thresholds", SR + _at_sql("scored_rows", "0.5", "default") + "\nUNION ALL\n"
          + _at_sql("scored_rows", "(SELECT threshold FROM best)", "tuned"), doubles=AT_D)
def metrics_at_thresholds(spark, sf):
    """Full metric rows at 0.5 and at the tuned threshold."""
    return M.metrics_at_thresholds(scored_rows(spark, sf))


FOLDS = f"""
folds AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {O.md5_key('row_id')}, row_id) - 1) % 5 AS fold
          FROM scored_rows),
fold_f1 AS (SELECT fold, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (
   SELECT fold, sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp,
          sum(CASE WHEN score >= 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS fp,
          sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn FROM folds GROUP BY fold) x)"""


@register("cv_summary", SR.rstrip() + "," + FOLDS + """
SELECT avg(f1) AS cv_mean, stddev_pop(f1) AS cv_std, count(*) AS n_folds,
       (SELECT f1 FROM best) AS test_f1, avg(f1) - (SELECT f1 FROM best) AS gap FROM fold_f1""",
          doubles=("cv_mean", "cv_std", "test_f1", "gap"))
def cv_summary(spark, sf):
    """Mean and population std of 5 stratified fold F1s; gap to tuned F1."""
    df = scored_rows(spark, sf)
    folds = M.fold_f1(W.stratified_kfold(df, 5))
    tuned = M.best_threshold(df).select("f1").scalar()
    return M.cv_summary(folds, tuned)


@register("class_weights", O.with_(O.SCORED_ROWS) + """SELECT label, count(*) AS n_c,
       (SELECT count(*) FROM scored_rows) / (2.0 * count(*)) AS balanced_weight,
       CASE WHEN label = 1 THEN (SELECT count(*) FILTER (WHERE label = 0) FROM scored_rows)
                                / greatest((SELECT count(*) FILTER (WHERE label = 1) FROM scored_rows), 1)
            ELSE 1.0 END AS ratio_weight
FROM scored_rows GROUP BY label""", doubles=("balanced_weight", "ratio_weight"))
def class_weights(spark, sf):
    """M3: balanced weights n/(2 n_c) and the safe/vulnerable ratio weight."""
    return M.class_weights(scored_rows(spark, sf))


VAL = f"""
parted AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {O.md5_key('row_id')}, row_id)
                      <= round(count(*) OVER (PARTITION BY label) * 0.15) THEN 'val' ELSE 'test' END AS part
  FROM scored_rows),
val_rows AS (SELECT * FROM parted WHERE part = 'val'),
test_rows AS (SELECT * FROM parted WHERE part = 'test')"""


@register("validation_tuned_eval",
          O.with_(O.SCORED_ROWS, VAL, rank_ctes("val_rows", "v_"), rank_ctes("test_rows", "t_"))
          + _at_sql("test_rows", "0.5", "default", "t_rank_m") + "\nUNION ALL\n"
          + _at_sql("test_rows", "(SELECT threshold FROM v_best)", "tuned", "t_rank_m"), doubles=AT_D)
def validation_tuned_eval(spark, sf):
    """Threshold tuned on a 15% stratified validation part, applied to the rest."""
    parted = W.stratified_split(scored_rows(spark, sf), 0.15)
    val = parted.filter(F.col("part") == "val")
    test = parted.filter(F.col("part") == "train")
    return M.metrics_at_thresholds(test, tune_on=val)
