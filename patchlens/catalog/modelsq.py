"""Model queries (M1, M4-M8, M12, M14, M16, S8, W11, W12, P12) over the whole
enriched function table split by project.

Fitted values have no SQL equivalent; ``tests/test_ml.py`` checks them by their
defining properties (gradient at the fit, recomputed probabilities, additivity)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.catalog.prep import PREP_CTES
from patchlens.operators import explain as X
from patchlens.operators import metrics as M
from patchlens.operators import ml as ML
from patchlens.operators import sampling as W
from patchlens.operators import tfidf as TF
from patchlens.operators import trees as TR
from patchlens.plans import preprocess as PP
from patchlens.session import materialize, scratch_path
from patchlens.sources.fixtures import functions_raw, text_rows

EXP_C = ML.EXPERIMENT_FEATURES["Exp-C: Structural + complexity (honest enriched)"]
ALL_FEATURES = ML.EXPERIMENT_FEATURES["Exp-A: All 11 features"]

SPLIT_CTES = PREP_CTES.rstrip() + f""",
projects AS (SELECT DISTINCT project FROM enriched),
ranked AS (SELECT project, row_number() OVER (ORDER BY {O.md5_key('project')}) AS r, count(*) OVER () AS n FROM projects),
assign AS (SELECT project, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS split FROM ranked),
parts AS (SELECT e.*, a.split FROM enriched e JOIN assign a ON e.project IS NOT DISTINCT FROM a.project)
"""


def _split(spark, sf, features=EXP_C):
    # The stored collected rows leave out what no feature needs, the stored split what the query's own ones don't.
    en = PP.enriched(functions_raw(spark, sf), columns=["project"], features=features).select("row_id", "project", "label", *features)
    s = materialize(W.project_wise_split(en))
    return ML.stored_for_fits(s.filter(F.col("split") == "train"), features), s.filter(F.col("split") == "test")


@register("assemble_features", SPLIT_CTES + "\nUNION ALL\n".join(
    f"SELECT row_id, {i} AS idx, CAST(coalesce({f}, 0) AS DOUBLE) AS value FROM parts WHERE split = 'train'"
    for i, f in enumerate(EXP_C)), ints=("idx",), doubles=("value",))
def assemble_features(spark, sf):
    """M1: chosen columns -> one vector (nulls -> 0), its entries by position."""
    train, _ = _split(spark, sf)
    v = ML.assemble(train, EXP_C)
    return v.select("row_id", F.posexplode(vector_to_array("features")).alias("idx", "value"))


@register("train_logreg")
def train_logreg(spark, sf):
    """M4: weighted L2 logistic regression (C=1, balanced) -> coefficients."""
    train, test = _split(spark, sf)
    tr, te, _ = ML.prepared(train, test, EXP_C)
    model = ML.logreg(ML.weight_sum(tr)).fit(tr)
    rows = [(f, float(c)) for f, c in zip(EXP_C, model.coefficients.toArray())]
    rows.append(("(intercept)", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coef double")


@register("train_forest")
def train_forest(spark, sf):
    """M5 + W11: 100 trees of depth 10 (balanced, seed 42) -> top 6 importances."""
    train, test = _split(spark, sf)
    tr, te, _ = ML.prepared(train, test, EXP_C)
    model = ML.fitted(ML.forest(), tr)
    return spark.createDataFrame(ML.top_importances(model, EXP_C, 6), "feature string, importance double")


@register("score_probability")
def score_probability(spark, sf):
    """M6: P(label=1) and the hard prediction for the test rows."""
    train, test = _split(spark, sf)
    tr, te, _ = ML.prepared(train, test, EXP_C)
    model = ML.logreg(ML.weight_sum(tr)).fit(tr)
    return ML.score(model, te).select("row_id", "label", "prob", "pred")


@register("top_importances")
def top_importances(spark, sf):
    """Top 6 features by |coefficient| of the logistic model."""
    train, test = _split(spark, sf)
    tr, te, _ = ML.prepared(train, test, EXP_C)
    model = ML.logreg(ML.weight_sum(tr)).fit(tr)
    return spark.createDataFrame(ML.top_importances(model, EXP_C, 6), "feature string, importance double")


@register("cross_validate")
def cross_validate(spark, sf):
    """M7: positive-class F1 on 5 stratified folds of the training rows, both models."""
    train, test = _split(spark, sf)
    tr, _, _ = ML.prepared(train, test, EXP_C)
    rows = tr.select("row_id", "label", "weight", "features")
    folded = materialize(ML.dealt(W.stratified_kfold(rows, 5), train.count()))
    out = [M.cv_summary(ML.cross_validate(folded, make, 5)).withColumn("model", F.lit(name))
           for name, make in ML.model_kinds().items()]
    return out[0].unionByName(out[1])


@register("experiment_matrix")
def experiment_matrix(spark, sf):
    """M8: 4 feature sets x {LR, RF with 100 trees} -> metric rows with 5-fold means and gaps."""
    train, test = _split(spark, sf, ALL_FEATURES)
    return ML.experiment_matrix(train, test, folds=5)


def _check_sql() -> str:
    parts = []
    from patchlens.catalog.prep import ENRICHED_OUT
    cols = set(ENRICHED_OUT) | {"commit_hash", "project", "lang", "diff", "func_before", "func_after",
                                "cwe_id", "cve_id", "cvss_score", "files_changed"}
    for i, (name, feats) in enumerate(ML.EXPERIMENT_FEATURES.items()):
        miss = ",".join(f for f in feats if f not in cols)
        parts.append(f"SELECT {i} AS ord, {O.lit(name)} AS experiment, {len(feats)} AS n_features, "
                     f"'{miss}' AS missing, (SELECT count(*) FROM enriched) AS n_rows")
    return PREP_CTES + "\nUNION ALL\n".join(parts)


@register("check_features", _check_sql(), ints=("ord", "n_features", "n_rows"))
def check_features(spark, sf):
    """Required features missing from the enriched table, per experiment."""
    en = PP.enriched(functions_raw(spark, sf))
    n_rows = en.agg(F.count(F.lit(1))).scalar()          # scalar subquery
    rows = [(i, name, len(feats), ",".join(ML.missing(en.columns, feats)))
            for i, (name, feats) in enumerate(ML.EXPERIMENT_FEATURES.items())]
    exp = spark.createDataFrame(rows, "ord int, experiment string, n_features int, missing string")
    return exp.select("*", n_rows.alias("n_rows"))


def _text_model(spark, sf, params):
    s = materialize(W.project_wise_split(text_rows(spark, sf)))
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    vocab, model = ML.fit_text_model(train, params)
    return train, test, vocab, model


def _text_metrics_of(spark, train, test, vocab, model, params):
    scored = materialize(ML.score_text(test, vocab, model, params).select("row_id", "label", F.col("prob").alias("score")))
    cv = M.cv_summary(ML.text_cross_validate(train, params)).first()      # one row of three numbers
    return M.metrics_at_thresholds(scored).withColumns({
        "cv_mean": F.lit(cv["cv_mean"]), "cv_std": F.lit(cv["cv_std"]), "gap": F.lit(cv["cv_mean"]) - F.col("f1")})


def _text_metrics(spark, sf, params):
    return _text_metrics_of(spark, *_text_model(spark, sf, params), params)


@register("train_text_model")
def train_text_model(spark, sf):
    """Word TF-IDF + weighted LR: metrics at 0.5 and tuned, 5-fold mean and gap."""
    return _text_metrics(spark, sf, TF.WORD)


@register("train_text_model_char")
def train_text_model_char(spark, sf):
    """The same with character n-grams."""
    return _text_metrics(spark, sf, TF.CHAR)


# Fixed demonstration model of the batch scorer: its scores are checked against SQL.
SCORER_WEIGHTS = [0.001, -0.01, 0.05, 0.02, -0.03, 0.5, 0.25]
SCORER_BIAS = -0.2
_margin = " + ".join(f"{w} * coalesce({f}, 0)" for w, f in zip(SCORER_WEIGHTS, EXP_C))


@register("batch_score", SPLIT_CTES + f"SELECT row_id, 1.0 / (1.0 + exp(-({_margin} + ({SCORER_BIAS})))) AS prob "
          "FROM parts WHERE split = 'test'", doubles=("prob",))
def batch_score(spark, sf):
    """Arrow-batched scoring of the test rows by a pluggable scorer."""
    _, test = _split(spark, sf)
    return ML.batch_score(test, EXP_C, ML.linear_scorer(SCORER_WEIGHTS, SCORER_BIAS))


@register("model_save_load", SPLIT_CTES + "SELECT m.model, 0.0 AS largest_difference, count(*) AS n_rows FROM parts, "
          "(VALUES ('forest'), ('logreg')) m(model) WHERE split = 'test' GROUP BY m.model",
          doubles=("largest_difference",), ints=("n_rows",))
def model_save_load(spark, sf):
    """Persist pipelines (scaler, vector, model) in the shared folder, reload, compare the test scores."""
    train, test = _split(spark, sf)
    out = []
    for name, make in (("logreg", None), ("forest", lambda d: ML.forest())):
        model = ML.fit_pipeline(train, EXP_C, make)
        path = scratch_path(spark, "model")
        ML.save_pipeline(model, path)
        loaded = ML.load_pipeline(path)
        both = ML.score(loaded, ML.score(model, test).select(*test.columns, F.col("prob").alias("direct")))
        out.append(both.agg(F.lit(name).alias("model"), F.max(F.abs(F.col("prob") - F.col("direct"))).alias("largest_difference"),
                            F.count(F.lit(1)).alias("n_rows")))
    return out[0].unionByName(out[1])


@register("text_model_save_load", "SELECT 0.0 AS largest_difference", doubles=("largest_difference",))
def text_model_save_load(spark, sf):
    """Persist vocabulary and model of the text classifier, reload, compare the test scores."""
    _, test, vocab, model = _text_model(spark, sf, TF.WORD)
    path = scratch_path(spark, "text-model")
    ML.save_text_model(vocab, model, path)
    again = ML.load_text_model(spark, path)
    a = ML.score_text(test, vocab, model, TF.WORD).select("row_id", F.col("prob").alias("direct"))
    b = ML.score_text(test, *again, TF.WORD).select("row_id", "prob")
    return a.join(b, "row_id").agg(F.max(F.abs(F.col("prob") - F.col("direct"))).alias("largest_difference"))


@register("top_tokens")
def top_tokens(spark, sf):
    """The 10 most positive and 10 most negative word-TF-IDF coefficients."""
    _, _, vocab, model = _text_model(spark, sf, TF.WORD)
    coefs = model.coefficients.toArray().tolist()
    cdf = spark.createDataFrame(list(enumerate(coefs)), "idx int, coef double").join(vocab, "idx")
    top = cdf.orderBy(F.col("coef").desc(), "term").limit(10).withColumn("side", F.lit("VULNERABLE"))
    low = cdf.orderBy(F.col("coef").asc(), "term").limit(10).withColumn("side", F.lit("SAFE"))
    return top.unionByName(low).select("side", "term", "coef")


def _explain_forest(train, test, model, n_perm, background):
    bg = W.capped_sample(train, background, seed=7)

    def predict(df):
        return ML.score(model, df).select(*df.columns, "prob")
    return X.sampled_shap(test.select("row_id", *EXP_C), EXP_C, bg.select(*EXP_C), predict, n_perm=n_perm, scorer=ML.array_scorer(model))


def _forest_pipeline(train):
    return ML.fit_pipeline(train, EXP_C, lambda d: ML.forest())


def _exact(model, rows):
    """Exact Shapley values of a fitted pipeline on ``rows``: phi, an array in the order of EXP_C, and base_value."""
    scored = ML.score(model, rows).select("row_id", "label", "prob", "features")
    last = model.stages[-1]
    if hasattr(last, "trees"):
        return TR.tree_shap(scored, last, deal=True)
    # Linear in scaled features, whose background means are 0.
    x = vector_to_array("features")
    phi = F.array(*[x[i] * F.lit(float(c)) for i, c in enumerate(last.coefficients.toArray())])
    return scored.withColumns({"phi": phi, "base_value": F.lit(float(last.intercept))}).drop("features")


@register("tree_shap")
def tree_shap(spark, sf):
    """Exact Shapley values of the forest's probability on every test row, path by path.

    base_value + sum(phi) over the features is prob."""
    train, test = _split(spark, sf)
    rows = _exact(_forest_pipeline(train), test)
    each = F.arrays_zip(F.array(*map(F.lit, EXP_C)).alias("feature"), F.col("phi").alias("value"))
    return rows.select("row_id", "prob", "base_value", F.inline(each)).select(
        "row_id", F.col("feature"), F.col("value").alias("phi"), "base_value", "prob")


@register("tree_importance", SPLIT_CTES + "SELECT f.feature, count(*) AS n_rows, true AS adds_up FROM parts, (VALUES "
          + ", ".join(f"('{f}')" for f in EXP_C) + ") f(feature) WHERE split = 'test' GROUP BY f.feature", ints=("n_rows", "adds_up"))
def tree_importance(spark, sf):
    """The law of the exact values: for every feature all test rows have one, and the row's values add up to its probability."""
    train, test = _split(spark, sf)
    rows = _exact(_forest_pipeline(train), test)
    whole = F.col("base_value") + F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    ok = rows.withColumn("ok", F.abs(whole - F.col("prob")) < 1e-9).select("ok", F.inline(F.arrays_zip(F.array(*map(F.lit, EXP_C)).alias("feature"), "phi")))
    return ok.groupBy("feature").agg(F.count("phi").alias("n_rows"), F.min("ok").alias("adds_up"))


@register("explain_saved_model")
def explain_saved_model(spark, sf):
    """W14 -> S8 -> A21: the better of the two fitted models, saved, reloaded and explained exactly on all test rows."""
    train, test = _split(spark, sf)
    best, best_f1, n = None, -1.0, 0
    for name, make in ML.model_kinds().items():
        model = ML.fit_pipeline(train, EXP_C, make)
        f1 = M.grouped_metrics(ML.score(model, test), (), 0.5, "prob", pred=F.col("pred") == 1).first()["f1"]
        if f1 >= best_f1:                                 # the forest wins a tie
            best, best_f1, n = model, f1, name
    path = scratch_path(spark, "best-model")
    ML.save_pipeline(best, path)
    rows = _exact(ML.load_pipeline(path), test)
    return X.global_importance(rows.withColumn("phi", F.transform("phi", lambda p: F.struct(p.alias("phi")))), EXP_C) \
        .withColumn("model", F.lit(n))


@register("sampled_shap")
def sampled_shap(spark, sf, n_perm: int = 16, background: int = 100):
    """Sampled-permutation Shapley values of the forest on every test row;
    additivity: sum(phi) = mean over the samples of f(x) - f(background row)."""
    train, test = _split(spark, sf)
    model = ML.fit_pipeline(train, EXP_C, lambda d: ML.forest(), fit=ML.scoring_model)
    return _explain_forest(train, test, model, n_perm, background)
