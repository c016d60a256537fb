"""Registered queries of fitted models, by laws that their numbers must keep."""
import pytest

from patchlens.catalog import load_all

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def queries():
    return load_all()


def f1(p, r):
    return 2 * p * r / (p + r) if p + r else 0.0


def test_stored_results_of_fitted_models(spark, queries):
    rows = queries["fitted_results"].run(spark, SF).collect()
    by = {r["approach"]: r for r in rows}
    assert sorted(r["stage"] for r in rows) == ["1-structural", "2-text", "2-text", "3-char"] and len(by) == 4
    base = next(r for r in rows if r["stage"] == "1-structural")
    for r in rows:
        assert r["f1"] == pytest.approx(f1(r["precision"], r["recall"]), abs=2e-6) and 0 <= r["auc"] <= 1
        assert r["f1_gain"] == pytest.approx(r["f1"] - base["f1"], abs=2e-6) and r["auc_gain"] == pytest.approx(r["auc"] - base["auc"], abs=2e-6)
        assert r["flag"] == ("check leakage" if r["f1"] > 0.95 else "realistic" if r["f1"] < 0.85 else "")
    assert by["Text model tuned"]["f1"] >= by["Text model default"]["f1"]


def test_report_of_the_text_model(spark, queries):
    rows = queries["report_text_model"].run(spark, SF).collect()
    at = {(r["section"], r["key"]): r["value"] for r in rows}
    for kind in ("default", "tuned"):
        assert at["f1", kind] == pytest.approx(f1(at["precision", kind], at["recall", kind]), abs=2e-6)
        assert at["gap", kind] == pytest.approx(at["cv_mean", kind] - at["f1", kind], abs=2e-6)
    high = sorted((r["value"] for r in rows if r["section"] == "towards vulnerable"), reverse=True)
    low = sorted(r["value"] for r in rows if r["section"] == "towards safe")
    assert len(high) == len(low) == 10 and high[-1] >= low[-1] and high[0] > 0 > low[0]
    terms = {r["key"]: r["value"] for r in rows if r["section"] in ("towards vulnerable", "towards safe")}
    tokens = {(r["side"], r["term"]): r["coef"] for r in queries["top_tokens"].run(spark, SF).collect()}
    assert {t for _, t in tokens} == set(terms) and all(terms[t] == pytest.approx(c, abs=1e-5) for (_, t), c in tokens.items())


def test_exact_values_of_the_better_saved_model(spark, queries):
    rows = sorted(queries["explain_saved_model"].run(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 8)) and len({r["feature"] for r in rows}) == 7
    sizes = [r["mean_abs_phi"] for r in rows]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 0 and len({r["model"] for r in rows}) == 1


def test_tree_values_of_every_test_row(spark, queries):
    rows = queries["tree_shap"].run(spark, "/root/testdata/sf0.001").collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["row_id"], [r["base_value"], r["prob"], 0])[0] += r["phi"]
        whole[r["row_id"]][2] += 1
    assert len(rows) == 7 * len(whole) and all(n == 7 and abs(total - prob) < 1e-5 for total, prob, n in whole.values())


def test_baseline_report_names_the_better_model(spark, queries):
    rows = queries["report_baseline"].run(spark, "/root/testdata/sf0.001").collect()
    f1s = {r["key"]: r["value"] for r in rows if r["section"] == "f1"}
    best = {r["key"]: r["text"] for r in rows if r["section"] == "best model"}
    assert len(f1s) == 8 and len(best) == 4
    for experiment, model in best.items():
        lr, rf = (f1s[f"{experiment} / {m}"] for m in ("Logistic Regression", "Random Forest"))
        assert model == ("Random Forest" if rf >= lr else "Logistic Regression")
