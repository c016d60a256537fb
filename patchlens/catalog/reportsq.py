"""The reports (S7) as long frames: cleaning, preprocessing, enrichment, explanation, baselines and text model."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import commits as CM
from patchlens.catalog import explainq as EX
from patchlens.catalog import modelsq as MQ
from patchlens.catalog import prep as PR
from patchlens.catalog import register
from patchlens.functions.enrich import ENRICHED_FEATURES
from patchlens.operators import explain as X
from patchlens.operators import filters as P
from patchlens.operators import metrics as M
from patchlens.operators import ml as ML
from patchlens.operators import profile as A
from patchlens.operators import sampling as W
from patchlens.operators import tfidf as TF
from patchlens.plans import commits as C
from patchlens.plans import preprocess as PP
from patchlens.session import materialize
from patchlens.sources import report as RP
from patchlens.sources.fixtures import functions_raw

LONG = {"ints": ("section_no", "ord"), "doubles": ("value",)}


def _sql(*parts: tuple) -> str:
    """Parts: (section, from-clause, ord, key, value, text)."""
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS section_no, {O.lit(name)} AS section, {o} AS ord, CAST({key} AS VARCHAR) AS key, "
        f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text FROM {src}"
        for i, (name, src, o, key, value, text) in enumerate(parts, 1))


def _facts_sql(name: str, src: str, names: dict) -> tuple:
    rows = " UNION ALL ".join(f"SELECT {i} AS o, {O.lit(key)} AS k, CAST({c} AS DOUBLE) AS v FROM {src}" for i, (c, key) in enumerate(names.items()))
    return name, f"({rows}) f", "o", "k", "v", "NULL"


CLEANED = {"avg_lines_added": "avg lines added", "avg_lines_removed": "avg lines removed", "avg_diff_length": "avg diff length",
           "security_hits": "security term hits", "kept": "commits kept"}


def cleaning_sections(raw) -> list[RP.Section]:
    """What the cleaning of commits removed and why, and the means of what it kept."""
    waterfall = materialize(P.drop_waterfall(C.prepared(raw)))     # a row per rule
    clean = C.clean_commits(raw)
    labels = clean.agg(F.count(F.lit(1)).alias("zero"), F.sum(F.col("label")).alias("one"))
    return [RP.Section("cleaning summary", waterfall.where("reason in ('original', 'kept')"), "reason", "n", ord="ord", places=0),
            RP.Section("removal reasons", waterfall.where("reason not in ('original', 'kept')"), "reason", "n", ord="ord", places=0),
            RP.facts("feature stats", A.dataset_means(clean), CLEANED, places=1),
            RP.facts("label distribution", labels, {"zero": "label=0 (placeholder)", "one": "label=1 (vulnerable)"}, places=0)]


@register("report_cleaning", CM.PREPARED.rstrip() + """,
rules AS (SELECT * FROM (VALUES (0, 'original'), (1, 'empty/too-short diff'), (2, 'diff too large (>10k chars)'),
                                (3, 'noise commit message'), (4, 'kept')) v(ord, reason)),
counts AS (SELECT drop_reason AS reason, count(*) AS n FROM reasoned GROUP BY drop_reason
           UNION ALL SELECT 'original', count(*) FROM reasoned),
fall AS (SELECT r.ord, r.reason, coalesce(c.n, 0) AS n FROM rules r LEFT JOIN counts c ON r.reason = c.reason),
means AS (SELECT avg(lines_added) AS avg_lines_added, avg(lines_removed) AS avg_lines_removed, avg(diff_length) AS avg_diff_length,
                 sum(has_security_terms) AS security_hits, count(*) AS kept, sum(label) AS one FROM commit_clean)
""" + _sql(("cleaning summary", "fall WHERE reason IN ('original', 'kept')", "ord", "reason", "n", "NULL"),
           ("removal reasons", "fall WHERE reason NOT IN ('original', 'kept')", "ord", "reason", "n", "NULL"),
           _facts_sql("feature stats", "means", CLEANED),
           _facts_sql("label distribution", "means", {"kept": "label=0 (placeholder)", "one": "label=1 (vulnerable)"})), **LONG)
def report_cleaning(spark, sf):
    """The commit cleaning report."""
    return RP.report(cleaning_sections(CM._raw(spark, sf)))


def preprocess_sections(raw, quotas: dict) -> list[RP.Section]:
    """What the preprocessing of functions collected, the classes it left, its commonest weaknesses and projects, and the column mapping."""
    funnel = materialize(PP.funnel_counts(raw, quotas))
    chunks = funnel.where("stage = 'rows_seen'").select(F.lit(0).alias("ord"), F.lit("chunks_read").alias("stage"),
                                                        F.ceil(F.col("n") / PP.CHUNK_SIZE).alias("n"))
    ready = PP.ready(raw, quotas)
    labels = A.label_distribution(ready, "label").select(F.concat(F.lit("label="), "label").alias("key"), "cnt")
    ratio = A.imbalance_ratio(ready, "label")
    mapping = raw.sparkSession.createDataFrame([(i, s, y) for i, (s, y) in enumerate(P.FUNCTION_COLUMN_MAP.items())], "ord int, source string, column string")
    return [RP.Section("collection results", chunks.unionByName(funnel), "stage", "n", ord="ord", places=0),
            RP.Section("label distribution", labels, "key", "cnt", places=0),
            RP.facts("imbalance", ratio, {"ratio": "safe rows for each vulnerable one"}, places=0),
            RP.Section("top cwe", A.top_values(ready.where("label = 1"), "cwe_id", 6), "value", "cnt", places=0),
            RP.Section("top projects", A.top_projects(ready, 6), "project", "total", places=0),
            RP.Section("column mapping", mapping, "source", text="column", ord="ord")]


_mapping = ", ".join(f"({i}, {O.lit(s)}, {O.lit(y)})" for i, (s, y) in enumerate(P.FUNCTION_COLUMN_MAP.items()))


@register("report_preprocess", PR.FUNNEL_SQL.split("\nSELECT 1 AS ord")[0] + f""",
per2 AS (SELECT 0 AS ord, 'chunks_read' AS stage, ceil(n / {PP.CHUNK_SIZE}) AS n FROM seen
  UNION ALL SELECT 1, 'rows_seen', n FROM seen UNION ALL SELECT 2, 'vulnerable_collected', coalesce(c1, 0) FROM per
  UNION ALL SELECT 3, 'safe_collected', coalesce(c0, 0) FROM per UNION ALL SELECT 4, 'after_dedup', (SELECT count(*) FROM ready)),
cwe AS (SELECT cwe_id, count(*) AS n FROM ready WHERE label = 1 GROUP BY cwe_id ORDER BY n DESC, cwe_id LIMIT 6),
proj AS (SELECT project, count(*) AS n FROM ready WHERE project IS NOT NULL GROUP BY project ORDER BY n DESC, project LIMIT 6)
""" + _sql(("collection results", "per2", "ord", "stage", "n", "NULL"),
           ("label distribution", "(SELECT label, count(*) AS n FROM ready GROUP BY label) l", "0", "'label=' || label", "n", "NULL"),
           ("imbalance", """(SELECT floor(count(*) FILTER (WHERE label = 0) / greatest(count(*) FILTER (WHERE label = 1), 1)) AS n FROM ready) r""",
            "0", "'safe rows for each vulnerable one'", "n", "NULL"),
           ("top cwe", "cwe", "0", "cwe_id", "n", "NULL"), ("top projects", "proj", "0", "project", "n", "NULL"),
           ("column mapping", f"(VALUES {_mapping}) m(o, s, y)", "o", "s", "NULL", "y")), **LONG)
def report_preprocess(spark, sf):
    """The function preprocessing report."""
    return RP.report(preprocess_sections(functions_raw(spark, sf), PR.QUOTAS))


def enrichment_sections(enriched) -> list[RP.Section]:
    """Feature means by class, their difference and its direction."""
    means = materialize(PP.feature_means_by_class(enriched, ENRICHED_FEATURES))
    out = [RP.Section(name, means, "feature", c, ord="ord") for name, c in
           (("mean, vulnerable", "vuln_mean"), ("mean, safe", "safe_mean"), ("difference", "difference"))]
    return [*out, RP.Section("direction", means, "feature", text="direction", ord="ord")]


@register("report_enrichment", PR.PREP_CTES.rstrip() + f""",
means AS ({PR.class_means_sql("enriched", ENRICHED_FEATURES)})
""" + _sql(("mean, vulnerable", "means", "ord", "feature", "vuln_mean", "NULL"), ("mean, safe", "means", "ord", "feature", "safe_mean", "NULL"),
           ("difference", "means", "ord", "feature", "difference", "NULL"), ("direction", "means", "ord", "feature", "NULL", "direction")), **LONG)
def report_enrichment(spark, sf):
    """The feature enrichment report."""
    return RP.report(enrichment_sections(PP.enriched(functions_raw(spark, sf))))


def explanation_sections(shap, features: list[str]) -> list[RP.Section]:
    """Importance over all rows, mean values by class, and the strongest features of the first row of each outcome."""
    by_class = materialize(X.shap_by_class(shap, features))
    first = X.first_per_outcome(shap).withColumnRenamed("row_id", "_id").withColumnRenamed("score", "_score")
    local = X.top_contributors(shap.join(F.broadcast(first), F.col("row_id") == F.col("_id"), "left_semi"))  # four rows at most
    named = first.join(local, F.col("row_id") == F.col("_id")).select(
        F.concat_ws(" ", "outcome", "feature").alias("key"), "pos", "phi", F.concat_ws(" ", F.lit("pushes to"), "direction").alias("text"))
    return [RP.Section("global importance", X.global_importance(shap, features), "feature", "mean_abs_phi", ord="rank"),
            RP.Section("mean value, vulnerable", by_class, "feature", "vuln_phi"), RP.Section("mean value, safe", by_class, "feature", "safe_phi"),
            RP.Section("gap", by_class, "feature", "gap"), RP.Section("by class", by_class, "feature", text="direction"),
            RP.Section("score of the first row", first, "outcome", "_score"),
            RP.Section("contribution", named, "key", "phi", ord="pos"), RP.Section("contribution pushes", named, "key", text="text", ord="pos")]


@register("report_explanation", EX.BASE.rstrip() + """,
imp AS (SELECT feature, avg(abs(phi)) AS v, row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS rank FROM shap_long GROUP BY feature),
cls AS (SELECT feature, avg(CASE WHEN label = 1 THEN phi END) AS vuln, avg(CASE WHEN label = 0 THEN phi END) AS safe FROM shap_long
        GROUP BY feature HAVING count(DISTINCT label) = 2),
outcomes AS (SELECT *, CASE WHEN score >= 0.5 AND label = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' ELSE 'FN' END AS outcome
             FROM (SELECT DISTINCT row_id, label, score FROM shap_long) x),
firsts AS (SELECT outcome, min(row_id) AS row_id, arg_min(score, row_id) AS score FROM outcomes GROUP BY outcome),
loc AS (SELECT outcome || ' ' || feature AS k, pos, phi, 'pushes to ' || CASE WHEN phi > 0 THEN 'VULN' ELSE 'SAFE' END AS t FROM (
  SELECT f.outcome, s.feature, s.phi, row_number() OVER (PARTITION BY s.row_id ORDER BY abs(s.phi) DESC, s.feature) AS pos
  FROM shap_long s JOIN firsts f ON s.row_id = f.row_id) y WHERE pos <= 5)
""" + _sql(("global importance", "imp", "rank", "feature", "v", "NULL"), ("mean value, vulnerable", "cls", "0", "feature", "vuln", "NULL"),
           ("mean value, safe", "cls", "0", "feature", "safe", "NULL"), ("gap", "cls", "0", "feature", "vuln - safe", "NULL"),
           ("by class", "cls", "0", "feature", "NULL", "CASE WHEN vuln - safe > 0 THEN 'up vuln' ELSE 'down safe' END"),
           ("score of the first row", "firsts", "0", "outcome", "score", "NULL"),
           ("contribution", "loc", "pos", "k", "phi", "NULL"), ("contribution pushes", "loc", "pos", "k", "NULL", "t")), **LONG)
def report_explanation(spark, sf):
    """The explanation report of the linear model of fixed coefficients."""
    return RP.report(explanation_sections(materialize(EX._shap(spark, sf)), EX.FEATURES))


METRICS = ("precision", "recall", "f1", "auc", "prauc")


def baseline_sections(matrix) -> list[RP.Section]:
    """Metrics of every experiment and model, and the better model of each experiment. ``matrix``: rows of ``experiment_matrix``."""
    from patchlens.operators import results as R
    rows = matrix.select(F.concat_ws(" / ", "experiment", "model").alias("key"), *METRICS)
    best = R.best_model(matrix)
    return [*[RP.Section(m, rows, "key", m) for m in METRICS],
            RP.Section("best model", best, "experiment", text="best_model"), RP.Section("best f1", best, "experiment", "f1")]


@register("report_baseline")
def report_baseline(spark, sf):
    """The report of the structured baselines, from fitted models."""
    train, test = MQ._split(spark, sf, MQ.ALL_FEATURES)
    return RP.report(baseline_sections(materialize(ML.experiment_matrix(train, test))))


def text_model_sections(metrics, coefficients, k: int = 10) -> list[RP.Section]:
    """Metrics at both thresholds, the cross-validation, and the terms of the ``k`` highest and lowest coefficients (term, coef)."""
    at = [RP.Section(m, metrics, "kind", m) for m in ("threshold", *METRICS, "cv_mean", "cv_std", "gap")]
    top = coefficients.orderBy(F.desc("coef"), "term").limit(k)
    low = coefficients.orderBy("coef", "term").limit(k)
    return [*at, RP.Section("towards vulnerable", top, "term", "coef"), RP.Section("towards safe", low, "term", "coef")]


@register("report_text_model")
def report_text_model(spark, sf):
    """The report of the word TF-IDF model, from a fitted model."""
    train, test, vocab, model = MQ._text_model(spark, sf, TF.WORD)
    metrics = materialize(MQ._text_metrics_of(spark, train, test, vocab, model, TF.WORD))
    coef = spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "idx int, coef double").join(vocab, "idx").select("term", "coef")
    return RP.report(text_model_sections(metrics, materialize(coef)))
