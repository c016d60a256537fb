"""Fitted models by their defining properties, and the explanations."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.operators import explain as X
from patchlens.operators import ml as ML
from patchlens.operators import sampling as W
from patchlens.operators import trees as TR

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.lit(3.0).alias("c"))
    noise = F.pmod(F.xxhash64("row_id"), F.lit(10))
    return df.withColumn("label", ((F.col("a") - F.col("b") + noise) > 6).cast("int")).cache()


def test_gradient_is_zero_at_the_fit(rows):
    tr, _, _ = ML.prepared(rows, rows, FEATURES)
    total = ML.weight_sum(tr)
    model = ML.logreg(total).fit(tr)
    z = [F.col("z_" + f) for f in FEATURES]
    coef = model.coefficients.toArray().tolist()
    margin = sum((F.lit(c) * x for c, x in zip(coef, z)), F.lit(model.intercept))
    error = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col("label"))
    g = tr.agg(*[F.sum(error * x).alias(f"g{i}") for i, x in enumerate([*z, F.lit(1.0)])]).first()
    for i in range(4):
        penalty = coef[i] if i < 3 else 0.0
        assert abs(g[i] + penalty) / total < 1e-4
    assert coef[2] == 0.0  # a constant feature


def test_probability_and_prediction_are_the_models(rows):
    tr, te, _ = ML.prepared(rows, rows, FEATURES)
    model = ML.logreg(ML.weight_sum(tr)).fit(tr)
    coef = model.coefficients.toArray().tolist()
    for r in ML.score(model, te).limit(50).collect():
        m = sum(c * r["z_" + f] for c, f in zip(coef, FEATURES)) + model.intercept
        assert r["prob"] == pytest.approx(1 / (1 + math.exp(-m))) and r["pred"] == int(r["prob"] > 0.5)


def test_importances(rows):
    tr, _, _ = ML.prepared(rows, rows, FEATURES)
    top = ML.top_importances(ML.forest(n_trees=10).fit(tr), FEATURES, 2)
    assert len(top) == 2 and top[0][1] >= top[1][1] and "c" not in dict(top)


def test_matrix_skips_what_it_must(rows):
    sets = {"both": ["a", "b"], "absent": ["a", "nope"]}
    got = ML.experiment_matrix(rows, rows, sets, n_trees=3, folds=3).collect()
    assert sorted((r["experiment"], r["model"]) for r in got) == [("both", "Logistic Regression"), ("both", "Random Forest")]
    assert all(r["gap"] == pytest.approx(r["cv_mean"] - r["f1"]) and r["n_folds"] == 3 for r in got)


def test_pipeline_is_saved_with_its_scaler(spark, rows, tmp_path):
    model = ML.fit_pipeline(rows, FEATURES)
    ML.save_pipeline(model, str(tmp_path / "m"))
    test = rows.withColumn("a", F.when(F.col("row_id") % 5 == 0, None).otherwise(F.col("a")))
    a = {r["row_id"]: r["prob"] for r in ML.score(model, test).collect()}
    b = {r["row_id"]: r["prob"] for r in ML.score(ML.load_pipeline(str(tmp_path / "m")), test).collect()}
    assert a == b and len(a) == 400


def test_any_scorer_can_be_plugged_in(rows):
    got = {r["row_id"]: r["prob"] for r in ML.batch_score(rows, ["a", "b"], lambda x: x[:, 0] * 10 + x[:, 1]).collect()}
    assert all(got[i] == (i % 11) * 10 + i % 7 for i in range(400))


@pytest.fixture(scope="module")
def shap(rows):
    stats = X.scaler_stats(rows, FEATURES)
    coefs = {"a": 0.8, "b": -0.5, "c": 2.0}
    return X.linear_shap(X.standard_scale(rows, FEATURES, stats), FEATURES, coefs, X.background_means(rows, FEATURES, stats), -0.25)


def test_linear_values_add_up_without_a_shuffle(shap):
    for r in shap.limit(50).collect():
        assert sum(e["phi"] for e in r["phi"]) == pytest.approx(r["margin"] - r["base_value"])
        assert r["phi"][2]["phi"] == 0.0 and r["score"] == pytest.approx(1 / (1 + math.exp(-r["margin"])))
    plan = X.unpivoted(shap, ["row_id"], "phi")._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Join" not in plan and "Exchange" not in plan


def test_plan_does_not_grow_with_the_features_squared(spark):
    from patchlens.catalog import load_all
    plan = load_all()["linear_shap"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert len(plan.toString()) < 200_000 and plan.executedPlan().toString().count("Scan parquet") == 1


def test_rankings_sort_the_rows_own_entries(shap):
    whole = {r["row_id"]: r for r in shap.collect()}
    top = {}
    for r in X.top_contributors(shap, 2).orderBy("row_id", "pos").collect():
        top.setdefault(r["row_id"], []).append(r["feature"])
    for i, r in whole.items():
        order = [e["feature"] for e in sorted(r["phi"], key=lambda e: (-abs(e["phi"]), e["feature"]))]
        assert top[i] == order[:2]
    ends = {r["row_id"]: r["value"] for r in X.shap_waterfall(shap).where("step = 3").collect()}
    assert all(ends[i] == pytest.approx(r["margin"]) for i, r in whole.items())
    assert [r["rank"] for r in X.global_importance(shap, FEATURES).orderBy("rank").collect()] == [1, 2, 3]
    assert X.shap_by_class(shap.where("label = 1"), FEATURES).collect() == []
    firsts = {r["outcome"]: r["row_id"] for r in X.first_per_outcome(shap).collect()}
    outcomes = {}
    for i in sorted(whole):
        r = whole[i]
        name = ("T" if (r["score"] >= 0.5) == (r["label"] == 1) else "F") + ("P" if r["score"] >= 0.5 else "N")
        outcomes.setdefault(name, i)
    assert firsts == outcomes


def test_sampled_values_add_up_and_agree_with_a_linear_model(rows):
    def predict(df):
        return df.withColumn("prob", 2 * F.col("a") - 3 * F.col("b") + 1)
    bg = W.capped_sample(rows, 1, seed=7)
    b = bg.first()
    got = {}
    for r in X.sampled_shap(rows.limit(40), FEATURES, bg, predict, n_perm=4).collect():
        got.setdefault(r["row_id"], {})[r["feature"]] = r["phi"]
    assert len(got) == 40
    for i, phi in got.items():
        assert phi["a"] == pytest.approx(2 * (i % 11 - b["a"])) and phi["b"] == pytest.approx(-3 * (i % 7 - b["b"])) and phi["c"] == 0
    with pytest.raises(ValueError):
        X.sampled_shap(rows, FEATURES, rows.limit(0), predict)


def subset_values(nodes, x, n):
    """Shapley values of one tree by enumeration: an unknown feature sends a row both ways, by the weights of the children."""
    def value(i, known):
        left, right, feature, threshold, weights = nodes[i]
        if left < 0:
            return weights[1] / sum(weights)
        if feature in known:
            return value(left if x[feature] <= threshold else right, known)
        return sum(sum(nodes[c][4]) * value(c, known) for c in (left, right)) / sum(weights)

    phi = [0.0] * n
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(others, k):
                share = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                phi[i] += share * (value(0, {*s, i}) - value(0, set(s)))
    return phi, value(0, set())


def random_tree(rng, n, depth):
    nodes = {}

    def grow(i, depth, weight):
        if depth == 0 or rng.random() < 0.15:
            one = rng.uniform(0, weight)
            nodes[i] = (-1, -1, -1, 0.0, (weight - one, one))
            return nodes[i][4]
        part = rng.uniform(0.1, 0.9) * weight
        left, right = 2 * i + 1, 2 * i + 2
        a, b = grow(left, depth - 1, part), grow(right, depth - 1, weight - part)
        nodes[i] = (left, right, rng.randrange(n), rng.choice([-1.0, 0.0, 0.5, 1.0]), (a[0] + b[0], a[1] + b[1]))
        return nodes[i][4]

    grow(0, depth, 100.0)
    return nodes


@pytest.mark.parametrize("rows", [7, 300])  # row by row, and from a table of patterns
def test_tree_values_equal_the_enumeration_of_all_subsets(rows):
    rng = random.Random(rows)
    for n, depth in ((1, 3), (4, 1), (4, 5), (6, 7)):
        forest = [random_tree(rng, n, depth) for _ in range(3)]
        x = np.array([[rng.choice([-2.0, -1.0, 0.0, 0.3, 1.0, 2.0, float("nan")]) for _ in range(n)] for _ in range(rows)])
        leaves = [TR.leaves_of(t, n, len(forest)) for t in forest]
        got = TR.explain(leaves, x)
        for i in range(min(rows, 7)):
            seen = [math.inf if math.isnan(v) else v for v in x[i]]
            want = [subset_values(t, seen, n) for t in forest]
            assert np.allclose(got[i], np.mean([w[0] for w in want], axis=0), atol=1e-12)
            assert sum(t.expected for t in leaves) == pytest.approx(np.mean([w[1] for w in want]), abs=1e-12)


def test_tree_values_add_up_to_the_forests_probability(rows):
    tr, te, _ = ML.prepared(rows.withColumn("d", F.pmod(F.xxhash64("a", "b", "row_id"), F.lit(5)).cast("double")), rows.withColumn("d", F.lit(2.0)), ["a", "b", "c", "d"])
    model = ML.forest(n_trees=8, depth=6).fit(tr)
    scored = ML.score(model, te).select("row_id", "prob", "features")
    whole = TR.tree_shap(scored, model)
    parted = {r["row_id"]: r["phi"] for r in TR.tree_shap(scored, model, part_bytes=1).collect()}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = whole.collect()
    assert len(got) == 400
    for r in got:
        assert abs(r["base_value"] + sum(r["phi"]) - r["prob"]) < 1e-9 and r["phi"][2] == 0.0  # a constant feature
        assert parted[r["row_id"]] == pytest.approx(r["phi"], abs=1e-12)
