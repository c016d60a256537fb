"""Forests grown from histograms of merged rows: cuts and leaves against a count row by row, quality against Spark's forest."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patchlens.operators import explain as X
from patchlens.operators import forests as FO
from patchlens.operators import metrics as M
from patchlens.operators import ml as ML
from patchlens.plans import preprocess as PP
from patchlens.sources.fixtures import functions_raw


def rows_of(spark, n=3000):
    x = spark.range(n).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("a"),
                              F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("b"), F.lit(2.0).alias("c"))
    x = x.withColumn("label", (F.col("a") + F.col("b") + F.pmod(F.xxhash64("row_id", F.lit(2)), F.lit(4)) > 8).cast("int"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(M.with_weights(x, "label", "weight"))


@pytest.fixture(scope="module")
def rows(spark):
    return rows_of(spark).repartition(3).cache()


def drawn(stored, size):
    """(cell, label, weight, draws by tree) of every merged row of stored slices."""
    out = []
    for r in stored.collect():
        n = len(r["labels"])
        parts = (np.frombuffer(r["cells"], np.uint8).reshape(size, n).T, np.frombuffer(r["labels"], np.uint8), np.frombuffer(r["weights"], "<f8"),
                 np.frombuffer(r["draws"], f"<u{r['width']}").reshape(-1, n).T)
        out += zip(*parts)
    return out


def gini(w):
    return 1 - sum((x / sum(w)) ** 2 for x in w) if sum(w) else 0.0


def test_every_row_is_merged_and_drawn(rows):
    cuts = FO.cuts_of(rows, 3)
    assert [len(c) for c in cuts][1:] == [4, 0] and len(cuts[0]) == 31
    cells = {tuple(map(int, FO.cells(cuts, np.array([r["features"].toArray()]))[0])) + (r["label"],) for r in rows.collect()}
    found = FO.merged(rows, cuts).collect()
    assert sum(r["n"] for r in found) == 3000 and {tuple(r["cell"][:4]) for r in found} == cells == {tuple(r["cell"][:4]) for r in found} and len(found) == len(cells)
    draws = np.array([d[3] for d in drawn(FO.slices(FO.merged(rows, cuts), 3, 50, 7), 3)])
    assert abs(draws.sum(axis=0).mean() - 3000) < 4 * (3000 / 50) ** 0.5 and abs(draws.sum(axis=0).std() / 3000 ** 0.5 - 1) < 0.5


def test_cuts_and_leaves_are_those_of_the_drawn_rows(rows, monkeypatch):
    monkeypatch.setattr(FO, "SLICE", 50)
    stored = []
    one = FO.materialize
    monkeypatch.setattr(FO, "materialize", lambda df: stored.append(one(df)) or stored[-1])
    depth = 4
    model = FO.grow(rows, 3, depth, 42)
    merged = drawn(stored[0], 3)
    for t in range(3):
        held = {1: [(c, y, w * d[t]) for c, y, w, d in merged if d[t]]}

        def weights(part):
            return [sum(w for _, y, w in part if y == k) for k in (0, 1)]

        for node in range(1, 1 << depth):
            part = held[node]
            f, k = model.feature[t, node], model.cut[t, node]
            held[2 * node] = [r for r in part if r[0][f] <= k]
            held[2 * node + 1] = [r for r in part if r[0][f] > k]
            if k == 255:
                continue
            whole = sum(weights(part))
            gains = [gini(weights(part)) - sum(sum(weights(s)) / whole * gini(weights(s)) for s in ([r for r in part if r[0][f] <= c], [r for r in part if r[0][f] > c]))
                     for c in range(31)]
            assert gains[k] == pytest.approx(max(gains)) and gains[k] > 0 and held[2 * node] and held[2 * node + 1]
        for leaf in range(1 << depth, 2 << depth):
            if held[leaf]:
                w = weights(held[leaf])
                assert model.leaves[t, leaf - (1 << depth)] == pytest.approx(w[1] / sum(w))
    x = np.array([[3.3, 2.0, 2.0], [9.9, 4.0, 2.0], [-1.0, 9.0, 0.0], [3.3, 2.0, 2.0], [float("nan"), 0.0, 2.0]])
    walked = []
    for c in FO.cells(model.cuts, x):
        node = [1] * 3
        for _ in range(depth):
            node = [2 * i + int(c[model.feature[t, i]] > model.cut[t, i]) for t, i in enumerate(node)]
        walked.append(np.mean([model.leaves[t, i - (1 << depth)] for t, i in enumerate(node)]))
    assert np.allclose(model.probabilities(x), walked)


def test_many_rows_get_a_forest_as_good_as_sparks(rows, monkeypatch):
    sparks = ML.scoring_model(ML.forest(n_trees=20), rows)
    assert isinstance(sparks, RandomForestClassificationModel)
    monkeypatch.setattr(ML, "DEALT_ROWS", 100)
    grown = ML.scoring_model(ML.forest(n_trees=20), rows)
    assert isinstance(grown, FO.ForestModel)
    a, b = (ML._evaluated(m, rows) for m in (sparks, grown))
    assert b["auc"] > 0.85 and abs(a["auc"] - b["auc"]) < 0.03 and abs(a["f1"] - b["f1"]) < 0.05
    scored = ML.score(grown, rows.limit(20)).collect()
    assert all(r["pred"] == int(r["prob"] > 0.5) and r["probability"].toArray().sum() == pytest.approx(1) for r in scored)


def test_folds_and_the_matrix_of_many_rows_grow_their_forests(rows, monkeypatch):
    fits = []
    monkeypatch.setattr(ML, "fitted", lambda e, d, one=ML.fitted: fits.append(type(e).__name__) or one(e, d))
    monkeypatch.setattr(ML, "DEALT_ROWS", 100)
    plain = rows.select("row_id", "a", "b", "c", "label")
    out = ML.experiment_matrix(plain, plain, {"all": ["a", "b", "c"]}, n_trees=5, folds=3).collect()
    assert len(out) == 2 and all(r["n_folds"] == 3 and r["cv_mean"] > 0.7 for r in out)
    assert fits and set(fits) == {"LogisticRegression"}


def test_no_row_but_those_of_the_two_classes(rows):
    with pytest.raises(ValueError):
        FO.grow(rows.withColumn("label", F.lit(2)), 2, 2, 1)
    with pytest.raises(ValueError):
        FO.grow(rows.limit(0), 2, 2, 1)
    pure = FO.grow(rows.withColumn("label", F.lit(1)), 2, 3, 1)
    assert np.allclose(pure.probabilities(np.array([[1.0, 1.0, 2.0]])), 1)


def test_sampled_values_by_arrays_are_those_of_states_as_rows(rows, monkeypatch):
    features = ["a", "b", "c"]
    some = rows.select("row_id", *features).where("row_id < 60").withColumn("a", F.when(F.col("row_id") != 5, F.col("a")))
    bg = rows.select(*features).where("row_id > 2990")
    a, b, c = (F.coalesce(F.col(f), F.lit(0.0)) for f in features)
    monkeypatch.setattr(X, "HELD_STATES", 100)

    def of(scorer):
        out = X.sampled_shap(some, features, bg, lambda d: d.withColumn("prob", a * b - c + a), n_perm=4, scorer=scorer)
        return out, {(r["row_id"], r["feature"]): r["phi"] for r in out.collect()}
    _, want = of(None)
    out, got = of(lambda x: x[:, 0] * x[:, 1] - x[:, 2] + x[:, 0])
    assert got == pytest.approx(want) and len(got) == 180 and len(set(got.values())) > 50
    assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_grown_forest_scores_arrays_as_its_pipeline_scores_rows(rows, monkeypatch):
    features = ["a", "b", "c"]
    plain = rows.select("row_id", "label", *features)
    assert ML.array_scorer(ML.fit_pipeline(plain, features, lambda d: ML.forest(n_trees=3), fit=ML.scoring_model)) is None
    monkeypatch.setattr(ML, "DEALT_ROWS", 100)
    model = ML.fit_pipeline(plain, features, lambda d: ML.forest(n_trees=5), fit=ML.scoring_model)
    some = plain.limit(100).withColumn("b", F.when(F.col("row_id") % 3 > 0, F.col("b"))).collect()
    df = rows.sparkSession.createDataFrame(some, "row_id long, label int, a double, b double, c double")
    want = {r["row_id"]: r["prob"] for r in ML.score(model, df).collect()}
    got = ML.array_scorer(model)(np.array([[r["a"], r["b"] or 0.0, r["c"]] for r in some]))
    assert {r["row_id"]: p for r, p in zip(some, got)} == pytest.approx(want)


def test_the_diff_is_not_stored_for_features_of_the_code(spark, monkeypatch):
    stored, one = [], PP.materialize
    monkeypatch.setattr(PP, "materialize", lambda df: stored.append(df.columns) or one(df))
    raw = functions_raw(spark, "/root/testdata/sf0.001").where("row_id < 400")
    code = ["func_before_length", "comment_ratio", "token_diversity"]
    few, whole = PP.enriched(raw, columns=["project"], features=code), PP.enriched(raw, columns=["project"], features=[*code, "lines_added"])
    assert "diff" not in stored[0] and "diff" in stored[1] and "lines_added" in whole.columns
    assert few.exceptAll(whole.select(few.columns)).count() == 0 and few.count() == whole.count() > 0


def test_folds_carry_only_what_fits_and_scores_need(spark, monkeypatch):
    from patchlens.catalog import modelsq as MQ
    stored = []
    monkeypatch.setattr(MQ, "materialize", lambda df: stored.append(df.columns) or df)
    monkeypatch.setattr(ML, "cross_validate", lambda folded, make, k: spark.createDataFrame([(0, 0.5)], "fold int, f1 double"))
    train = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("p").alias("project"),
                                   *[F.col("id").cast("double").alias(f) for f in MQ.EXP_C])
    monkeypatch.setattr(MQ, "_split", lambda spark, sf, features=None: (train, train))
    assert MQ.cross_validate(spark, "").count() == 2 and stored == [["row_id", "label", "weight", "features", "fold"]]
