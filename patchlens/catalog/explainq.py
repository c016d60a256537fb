"""Explanation queries (M2, M13, A21, A22, W9, W10, W13) over the whole
enriched function table: scaler fitted on the train projects, test rows
explained with a linear model of fixed coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.catalog.prep import WHOLE, enrich_select
from patchlens.functions import text as T
from patchlens.functions.enrich import enrich_all
from patchlens.operators import explain as X
from patchlens.operators import ml as ML
from patchlens.operators import sampling as W
from patchlens.session import materialize
from patchlens.sources.fixtures import functions_raw

# The explained model's inputs: the structural + complexity set.
FEATURES = ML.EXPERIMENT_FEATURES["Exp-C: Structural + complexity (honest enriched)"]
# Demonstration coefficients of the explained linear model (fixed, not fitted).
COEFS = [0.8, -0.1, 0.2, 0.9, 0.05, -0.5, 0.15]
INTERCEPT = -0.25


def _wide(spark, sf):
    """All rows' features with their part, stored once: the scaler and the explained rows read it."""
    raw = functions_raw(spark, sf)
    df = raw.select("row_id", "project", F.col("vul").alias("label"), "func_before",
                    T.clean_patch(F.coalesce(F.col("patch"), F.lit(""))).alias("diff"))
    en = enrich_all(df, keep_raw_counts=False)
    return materialize(W.project_wise_split(en).select("row_id", "label", "split",
                                                       *[F.col(f).cast("double").alias(f) for f in FEATURES]))


def _scaled(spark, sf):
    wide = _wide(spark, sf)
    stats = X.scaler_stats(wide.where("split = 'train'"), FEATURES)
    return X.standard_scale(wide.where("split = 'test'"), FEATURES, stats)


def _shap(spark, sf):
    # The background is the train rows, whose scaled means are 0.
    return X.linear_shap(_scaled(spark, sf), FEATURES, dict(zip(FEATURES, COEFS)), dict.fromkeys(FEATURES, 0.0), INTERCEPT)


_coef_rows = ", ".join(f"('{f}', {c})" for f, c in zip(FEATURES, COEFS))
BASE = O.with_(O.FUNCTIONS_RAW).rstrip() + ",\n" + WHOLE.strip().replace(
    "SELECT row_id, vul AS label,", "SELECT row_id, project, vul AS label,") + f""",
en AS ({enrich_select("whole", keep="row_id, project, label")}),
projects AS (SELECT DISTINCT project FROM en),
ranked AS (SELECT project, row_number() OVER (ORDER BY {O.md5_key('project')}) AS r,
                  count(*) OVER () AS n FROM projects),
assign AS (SELECT project, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS split
           FROM ranked),
wide AS (SELECT e.row_id, e.label, a.split, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)}
         FROM en e JOIN assign a ON e.project IS NOT DISTINCT FROM a.project),
long AS (UNPIVOT wide ON {", ".join(FEATURES)} INTO NAME feature VALUE value),
stats AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM long WHERE split = 'train'
          GROUP BY feature),
scaled AS (SELECT l.row_id, l.label, l.split, l.feature, l.value,
                  CASE WHEN s.std = 0 THEN 0.0 ELSE (l.value - s.mean) / s.std END AS scaled
           FROM long l JOIN stats s ON l.feature = s.feature),
coefs AS (SELECT * FROM (VALUES {_coef_rows}) v(feature, coef)),
bg AS (SELECT feature, avg(scaled) AS bg_mean FROM scaled WHERE split = 'train' GROUP BY feature),
j AS (SELECT s.*, c.coef, b.bg_mean, c.coef * (s.scaled - b.bg_mean) AS phi
      FROM scaled s JOIN coefs c ON s.feature = c.feature JOIN bg b ON s.feature = b.feature
      WHERE s.split = 'test'),
per_row AS (SELECT row_id, sum(coef * scaled) + ({INTERCEPT}) AS margin,
                   sum(coef * bg_mean) + ({INTERCEPT}) AS base_value FROM j GROUP BY row_id),
shap_long AS (SELECT j.row_id, j.feature, j.scaled, j.phi, j.label, 1.0 / (1.0 + exp(-p.margin)) AS score,
                     p.margin, p.base_value FROM j JOIN per_row p ON j.row_id = p.row_id)
"""


@register("standard_scale", BASE + "SELECT row_id, feature, value, scaled FROM scaled WHERE split = 'test'",
          doubles=("value", "scaled"))
def standard_scale(spark, sf):
    """M2: (x - train mean) / train population std on test rows; constant -> 0."""
    return X.unpivoted(_scaled(spark, sf), ["row_id"], "scaled")


@register("linear_shap", BASE + "SELECT row_id, feature, scaled, phi, label, score, base_value FROM shap_long",
          doubles=("scaled", "phi", "score", "base_value"))
def linear_shap(spark, sf):
    """Exact linear Shapley values, background = train mean."""
    return X.unpivoted(_shap(spark, sf).drop("scaled"), ["row_id", "label", "score", "base_value"], "phi")


@register("global_importance", BASE + """SELECT feature, avg(abs(phi)) AS mean_abs_phi,
       row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS rank FROM shap_long GROUP BY feature""",
          doubles=("mean_abs_phi",), ints=("rank",))
def global_importance(spark, sf):
    """Mean |phi| per feature, ranked."""
    return X.global_importance(_shap(spark, sf), FEATURES)


@register("shap_by_class", BASE + """SELECT feature, vuln_phi, safe_phi, vuln_phi - safe_phi AS gap,
       CASE WHEN vuln_phi - safe_phi > 0 THEN 'up vuln' ELSE 'down safe' END AS direction FROM (
  SELECT feature, avg(CASE WHEN label = 1 THEN phi END) AS vuln_phi, avg(CASE WHEN label = 0 THEN phi END) AS safe_phi,
         max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS h0
  FROM shap_long GROUP BY feature) x WHERE h1 = 1 AND h0 = 1""", doubles=("vuln_phi", "safe_phi", "gap"))
def shap_by_class(spark, sf):
    """Mean phi per feature for each class, gap and sign."""
    return X.shap_by_class(_shap(spark, sf), FEATURES)


@register("first_per_outcome", BASE + """, rows AS (SELECT DISTINCT row_id, label, score FROM shap_long),
o AS (SELECT *, CASE WHEN score >= 0.5 AND label = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP'
                     WHEN label = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM rows)
SELECT outcome, min(row_id) AS row_id, arg_min(score, row_id) AS score FROM o GROUP BY outcome""".replace(
    '\n, rows AS', ',\nrows AS'), doubles=("score",))
def first_per_outcome(spark, sf):
    """First explained row of each outcome (TP, FP, TN, FN) at 0.5."""
    return X.first_per_outcome(_shap(spark, sf))


@register("top_contributors", BASE + """SELECT row_id, pos, feature, scaled, phi,
       CASE WHEN phi > 0 THEN 'VULN' ELSE 'SAFE' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS pos FROM shap_long) x
WHERE pos <= 5""", ints=("pos",), doubles=("scaled", "phi"))
def top_contributors(spark, sf):
    """Top 5 features per row by |phi| with direction."""
    return X.top_contributors(_shap(spark, sf))


@register("shap_waterfall", BASE + """SELECT row_id,
       row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS step, feature, phi,
       base_value + sum(phi) OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM shap_long""", ints=("step",), doubles=("phi", "value"))
def shap_waterfall(spark, sf):
    """Base value then the running sum of contributions per row."""
    return X.shap_waterfall(_shap(spark, sf))
