"""Models with Spark ML.

* Logistic regression matches an L2 objective ``C * sum(w_i * loss_i) +
  0.5 * ||beta||^2``: Spark minimises ``sum(w_i loss_i) / sum(w_i) +
  regParam * 0.5 * ||beta||^2``, so ``regParam = 1 / (C * sum(w))``, with
  ``standardization=False`` (features are scaled beforehand with the
  population std).
* Class weights are the balanced weights ``n / (2 n_c)`` as ``weightCol``.
* Training data stays distributed: the driver only plans the iterations;
  gradients and tree statistics are aggregated on the executors.
"""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators import forests
from patchlens.operators import metrics as M
from patchlens.operators import tfidf as TF
from patchlens.operators.features import EXPERIMENT_FEATURES
from patchlens.operators.sampling import stratified_kfold
from patchlens.session import materialize

SEED = 42

# M1 + M2
def fit_scaler(train: DataFrame, features: list[str]) -> dict:
    """Train mean and population std per feature (a one-row aggregate)."""
    row = train.agg(*[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias("m_" + f) for f in features],
                    *[F.stddev_pop(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias("s_" + f)
                      for f in features]).first()
    return {f: (row["m_" + f], row["s_" + f]) for f in features}


def scale(df: DataFrame, stats: dict, out_prefix: str = "z_") -> DataFrame:
    cols = []
    for f, (m, s) in stats.items():
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        cols.append((F.lit(0.0) if not s else (x - F.lit(m)) / F.lit(s)).alias(out_prefix + f))
    return df.select("*", *cols)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Columns -> one vector column; nulls -> 0."""
    filled = df.fillna(0, subset=features)
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(filled)


# M3
def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    return M.with_weights(df, label, out)


# M4
def logreg(weight_sum: float, C: float = 1.0, features: str = "features", label: str = "label",
           weight: str = "weight", max_iter: int = 1000) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight,
                              regParam=1.0 / (C * weight_sum), elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter, tol=1e-6)


# M5
def forest(features: str = "features", label: str = "label", weight: str = "weight",
           n_trees: int = 100, depth: int = 10) -> RandomForestClassifier:
    """Each row's node in every tree is kept from pass to pass, in place of a walk from all roots; the trees are the same."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight,
                                  numTrees=n_trees, maxDepth=depth, seed=SEED, cacheNodeIds=True, checkpointInterval=-1)


# M6
def score(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("prob", vector_to_array("probability")[1]).withColumn(
        "pred", F.col("prediction").cast("int"))


def prepared(train: DataFrame, test: DataFrame, features: list[str]):
    """Scale with train statistics, assemble, attach balanced weights."""
    stats = fit_scaler(train, features)
    z = ["z_" + f for f in features]
    tr = assemble(balanced_weights(scale(train, stats)), z)
    te = assemble(scale(test, stats), z)
    return tr, te, stats


def weight_sum(df: DataFrame, weight: str = "weight") -> float:
    return df.agg(F.sum(weight)).first()[0]


#: Rows of a task from which a fit is worth more tasks.
DEALT_ROWS = 1 << 12


def many(rows: DataFrame, n_rows: int) -> bool:
    return n_rows >= rows.sparkSession.sparkContext.defaultParallelism * DEALT_ROWS


def dealt(rows: DataFrame, n_rows: int, features: list[str] = ()) -> DataFrame:
    """``rows``, ``n_rows`` of them, dealt out evenly over the cores for the many passes of a fit; to be stored. Few rows stay as they are.

    Each core's rows are sorted by ``features``, those of few values first: rows that are alike come one after the other,
    so that a pass of a forest updates the same nodes again and again instead of all of them in turn.
    """
    if not many(rows, n_rows):
        return rows
    out = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    if not features:
        return out
    values = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first().asDict()
    return out.sortWithinPartitions(*sorted(features, key=values.get))


def stored_for_fits(train: DataFrame, features: list[str]) -> DataFrame:
    """The training rows as ``dealt`` leaves them, stored if they were dealt out."""
    n_rows = train.count()
    return materialize(dealt(train, n_rows, features)) if many(train, n_rows) else train


def fitted(estimator, rows: DataFrame):
    """The model of ``rows``, read by a task per core at most: in each pass of a forest every task sends statistics of all nodes."""
    return estimator.fit(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism))


def scoring_model(estimator, rows: DataFrame):
    """The model of ``rows``, to score others with. On many rows a forest is grown from histograms of merged rows: another draw of the same kind of forest."""
    if isinstance(estimator, RandomForestClassifier) and many(rows, rows.count()):
        return forests.grow(rows, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed(), estimator.getFeaturesCol(),
                            estimator.getLabelCol(), estimator.getWeightCol())
    return fitted(estimator, rows)


def _in_parallel(spark, jobs: list, parallelism: int = 4) -> list:
    """Results of independent fits; a cluster runs their jobs side by side."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def _evaluated(model, rows: DataFrame, label: str = "label") -> dict:
    """The metrics of a model's own predictions on ``rows`` (one aggregated row)."""
    return M.grouped_metrics(score(model, rows), (), 0.5, "prob", label, pred=F.col("pred") == 1).first().asDict()


# M7
def cross_validate(train: DataFrame, make_estimator, k: int = 5, label: str = "label") -> DataFrame:
    """F1 of the positive class on each of k stratified folds (fold column 'fold')."""
    def one(f):
        fit_part = train.filter(F.col("fold") != f)
        model = scoring_model(make_estimator(fit_part), fit_part)
        return f, _evaluated(model, train.filter(F.col("fold") == f), label)["f1"]
    spark = train.sparkSession
    return spark.createDataFrame(_in_parallel(spark, [partial(one, f) for f in range(k)]), "fold int, f1 double")


def model_kinds(n_trees: int = 100) -> dict:
    """Model name -> estimator for a training frame."""
    return {"Logistic Regression": lambda d: logreg(weight_sum(d)), "Random Forest": lambda d: forest(n_trees=n_trees)}


MATRIX = ("experiment string, model string, threshold double, tp long, fp long, fn long, tn long, precision double, "
          "recall double, f1 double, auc double, prauc double")


# M8
def experiment_matrix(train: DataFrame, test: DataFrame, experiments: dict = EXPERIMENT_FEATURES,
                      n_trees: int = 100, folds: int = 0) -> DataFrame:
    """Test metrics for each feature set x {logistic regression, random forest}.

    Predictions are the model's own. With ``folds`` also the mean and deviation of
    the F1 of that many stratified folds of the training rows, and gap = mean - test F1. Sets whose features are missing, or
    whose test split has one class, are skipped (P12 / P13).
    """
    spark = train.sparkSession
    if test.agg(F.countDistinct("label")).first()[0] < 2:
        experiments = {}
    n_train = train.count()

    def fit(name, mname, make, tr, te):
        row = {"experiment": name, "model": mname, **_evaluated(scoring_model(make(tr), tr), te)}
        if folds:
            cv = M.cv_summary(cross_validate(tr, make, folds)).first().asDict()
            row |= {**cv, "gap": cv["cv_mean"] - row["f1"]}
        return row

    jobs = []
    for name, feats in experiments.items():
        if not missing(train.columns, feats):
            tr, te, _ = prepared(train, test, feats)
            tr = tr.select("row_id", "label", "weight", "features", *feats) if folds else tr
            tr = dealt(stratified_kfold(tr, folds) if folds else tr, n_train, feats)
            tr = materialize(tr.select("label", "weight", "features", *(["fold"] if folds else [])))
            jobs += [partial(fit, name, mname, make, tr, te) for mname, make in model_kinds(n_trees).items()]
    schema = MATRIX + (", cv_mean double, cv_std double, n_folds long, gap double" if folds else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in _in_parallel(spark, jobs, 2)], schema)


def missing(columns: list[str], features: list[str]) -> list[str]:
    return [f for f in features if f not in columns]


# W11
def top_importances(model, names: list[str], k: int = 6) -> list[tuple[str, float]]:
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    return sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))[:k]


# S8
def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_pipeline(train: DataFrame, features: list[str], make_estimator=None, fit=None) -> PipelineModel:
    """Scaler (population std of ``train``), vector and model as one pipeline that is saved and loaded whole.

    ``fit(estimator, rows)`` makes the model of the prepared rows in place of the estimator: with ``scoring_model`` one to score with, not to save.
    """
    stats = fit_scaler(train, features)
    cols = [f"coalesce(cast(`{f}` as double), 0.0D)" for f in features]
    scaled = ", ".join((f"({c} - {m!r}D) / {s!r}D" if s else "0.0D") + f" AS `z_{f}`" for c, f, (m, s) in
                       zip(cols, features, stats.values()))
    stages = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
              VectorAssembler(inputCols=["z_" + f for f in features], outputCol="features", handleInvalid="keep")]
    weighted = balanced_weights(train)
    estimator = make_estimator(weighted) if make_estimator else logreg(weight_sum(weighted))
    if fit is None:
        return fitted(Pipeline(stages=[*stages, estimator]), weighted)
    rows = PipelineModel(stages).transform(weighted).select("label", "weight", "features")
    model = PipelineModel([*stages, fit(estimator, rows)])
    model.scaler = stats
    return model


def array_scorer(model: PipelineModel):
    """P(label = 1) of the rows of a matrix of raw features (nulls as 0), as ``fit_pipeline``'s model with a grown forest gives it; None for other models."""
    forest_, stats = model.stages[-1], getattr(model, "scaler", None)
    if stats is None or not isinstance(forest_, forests.ForestModel):
        return None
    mean = np.array([m for m, _ in stats.values()], float)
    std = np.array([s or np.inf for _, s in stats.values()], float)        # a constant feature scales to 0
    return lambda x: forest_.probabilities((x - mean) / std)


# M12
def fit_text_model(train: DataFrame, params: TF.TfidfParams):
    """(vocabulary, model) of a weighted logistic regression on the TF-IDF vectors of ``train`` (row_id, text, label).

    Documents without a vocabulary term take part with an empty vector.
    """
    if params.analyzer == "word":
        vocab, long = TF.fit_transform(train, params)
        vocab = materialize(vocab)
        rows = TF.to_sparse(train.select("row_id", "label"), long, params.max_features)
    else:
        vocab = TF.fit_char_vocabulary(train, params)
        rows = TF.char_vectors(train.select("row_id", "text", "label"), vocab, params).drop("text")
    rows = materialize(balanced_weights(rows))
    return vocab, logreg(weight_sum(rows)).fit(rows)


def score_text(docs: DataFrame, vocab: DataFrame, model, params: TF.TfidfParams) -> DataFrame:
    """``docs`` with prob and pred, one row per document."""
    if params.analyzer != "word":
        return score(model, TF.char_vectors(docs, vocab, params))
    long = TF.transform(TF.term_counts(docs, params), vocab)
    return score(model, TF.to_sparse(docs, long, params.max_features))


def text_cross_validate(train: DataFrame, params: TF.TfidfParams, k: int = 5) -> DataFrame:
    """F1 of each of k stratified folds; vocabulary and model are fitted without the fold.

    All folds' vocabularies come from one aggregate, and their vectors from the same stored counts: of words, which are tokenised once,
    by document and term; of character n-grams, read once more, lists by document of the terms of any of the vocabularies.
    """
    folded = materialize(stratified_kfold(train, k).select("row_id", "text", "label", "fold"))
    rows = folded.select("row_id", "label", "fold")
    if params.analyzer == "word":
        tc = materialize(TF.term_counts(folded, params, keep=("fold",)))
    else:
        tc = materialize(TF.char_stats(folded, params, part="fold").withColumnRenamed("part", "fold"))
    vocabularies = TF.fold_vocabularies(tc, rows, params, k)

    def vectors(f, mine):
        long = TF.transform(tc.filter(mine).drop("fold"), vocab[f])
        return TF.to_sparse(rows.filter(mine), long, params.max_features)

    vocab = [materialize(v) for v in vocabularies]
    if params.analyzer != "word":
        terms = sorted({r["term"] for v in vocab for r in v.select("term").collect()})
        counted = materialize(TF.char_counts(TF.char_docs(folded, part="fold", keep=("label",)), terms, params))

    def part(f, inside):
        if params.analyzer == "word":
            return vectors(f, F.col("fold") == f if inside else F.col("fold") != f)
        return TF.fold_vectors(counted, terms, vocab[f], params.max_features, f, inside, ("label",))

    def one(f):
        fitted = materialize(balanced_weights(part(f, False)))
        model = logreg(weight_sum(fitted)).fit(fitted)
        return f, M.grouped_metrics(score(model, part(f, True)), (), 0.5, "prob", pred=F.col("pred") == 1).first()["f1"]
    spark = train.sparkSession
    return spark.createDataFrame(_in_parallel(spark, [partial(one, f) for f in range(k)]), "fold int, f1 double")


def save_text_model(vocab: DataFrame, model, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.write().overwrite().save(f"{path}/model")


def load_text_model(spark, path: str):
    return spark.read.parquet(f"{path}/vocabulary"), LogisticRegressionModel.load(f"{path}/model")


# M16
def linear_scorer(weights: list[float], bias: float):
    """Scorer of a linear model for ``batch_score``."""
    import numpy as np
    w = np.asarray(weights, dtype="float64")
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))


def batch_score(df: DataFrame, features: list[str], scorer, id_col: str = "row_id") -> DataFrame:
    """(id, prob) in Arrow batches. ``scorer``: any function of a (rows, features) array of doubles, nulls as 0."""
    def predict(batches):
        for pdf in batches:
            x = pdf[features].fillna(0.0).to_numpy(dtype="float64")
            yield pdf[[id_col]].assign(prob=scorer(x))
    schema = f"{id_col} long, prob double"
    return df.select(id_col, *[F.col(f).cast("double") for f in features]).mapInPandas(predict, schema)
