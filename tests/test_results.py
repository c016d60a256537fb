"""Results table, one-class metrics and null groups."""
import pytest
from pyspark.sql import functions as F

from patchlens.operators import metrics as M
from patchlens.operators import results as R

COLUMNS = "stage string, approach string, model string, f1 double, auc double, prauc double, recall double, precision double"


def test_update_keeps_rows_that_share_a_key(spark):
    table = spark.createDataFrame([("1", "A", "LR", 0.1, 0.9, None, 0.1, 0.1), ("1", "A", "RF", 0.8, 0.2, None, 0.1, 0.1),
                                   ("2", "B", "LR", 0.3, 0.3, 0.3, 0.3, 0.3), ("3", None, "X", 0.5, 0.5, 0.5, 0.5, 0.5)], COLUMNS)
    none = spark.createDataFrame([], "approach string, f1 double, auc double, prauc double, recall double, precision double")
    assert sorted(map(tuple, R.update_results_row(table, none).collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    update = spark.createDataFrame([("A", 0.7, None, 0.6, 0.5, 0.4), ("unknown", 1.0, 1.0, 1.0, 1.0, 1.0)], none.schema)
    rows = {(r["approach"], r["model"]): r for r in R.update_results_row(table, update).collect()}
    assert len(rows) == 4
    assert all(rows["A", m]["f1"] == 0.7 and rows["A", m]["auc"] is None for m in ("LR", "RF"))
    assert rows["B", "LR"]["f1"] == 0.3 and rows[None, "X"]["f1"] == 0.5


def test_update_refuses_a_key_twice(spark):
    table = spark.createDataFrame([("1", "A", "LR", 0.1, 0.9, None, 0.1, 0.1)], COLUMNS)
    twice = spark.createDataFrame([("A", 0.7, 0.1, 0.6, 0.5, 0.4)] * 2,
                                  "approach string, f1 double, auc double, prauc double, recall double, precision double")
    with pytest.raises(Exception, match="more than one update for A"):
        R.update_results_row(table, twice).collect()


def test_best_model_takes_the_forest_on_a_tie(spark):
    rows = [("Exp-A: x", "Logistic Regression", 0.5), ("Exp-A: x", "Random Forest", 0.5),
            ("Exp-B: y", "Logistic Regression", 0.6), ("Exp-B: y", "Random Forest", 0.5)]
    got = {r["tag"]: r["best_model"] for r in R.best_model(spark.createDataFrame(rows, "experiment string, model string, f1 double")).collect()}
    assert got == {"ExpA": "Random Forest", "ExpB": "Logistic Regression"}


@pytest.mark.parametrize("label,auc,ap", [(0, None, 0.0), (1, None, 1.0)])
def test_one_class(spark, label, auc, ap):
    df = spark.createDataFrame([(label, s / 10) for s in range(10)], "label int, score double")
    r = M.ranking_metrics(df).first()
    assert r["auc"] == auc and r["prauc"] == pytest.approx(ap)
    assert M.metrics_at_thresholds(df).count() == 2


def test_null_group_and_given_prediction(spark):
    rows = [(g, l, s, p) for g in (None, "a") for l, s, p in ((1, 0.9, 0), (0, 0.1, 0), (1, 0.4, 1))]
    df = spark.createDataFrame(rows, "g string, label int, score double, pred int")
    got = {r["g"]: r for r in M.grouped_metrics(df, ["g"]).collect()}
    assert set(got) == {None, "a"} and got[None]["auc"] == 1.0 and got[None]["tp"] == 1
    got = M.grouped_metrics(df, ["g"], pred=F.col("pred") == 1).collect()
    assert all((r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 0, 1) for r in got)


def test_no_step_gathers_a_groups_scores(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score"))
    plan = M.grouped_metrics(df)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    # Windows over scores are dealt out by group and range; only range totals are dealt by group alone.
    assert windows and all("_b#" in x if "(pos#" in x else "_bp#" in x for x in windows)


ROWS = [("1-a", "x", "m", 0.5, 0.6, None, 0.7, 0.8), ("2-b", "y", "m", 0.1, 0.2, 0.3, 0.4, 0.5), ("2-b", "z", "m", None, None, None, None, None),
        ("3-c", "y", "m", 0.9, 0.9, 0.9, 0.9, 0.9), ("4-d", None, "m", 0.0, 0.0, 0.0, 0.0, 0.0)]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_stored_update_touches_its_stages_only_and_can_be_repeated(spark, tmp_path):
    path = tmp_path / "results"
    R.store_results(spark.createDataFrame(ROWS, R.RESULT_SCHEMA), str(path))
    before = files(path)
    assert sorted(map(tuple, R.stored_results(spark, str(path)).collect()), key=repr) == sorted(ROWS, key=repr)
    new = spark.createDataFrame([("z", 0.11, 0.12, 0.13, 0.14, 0.15), ("nowhere", 1.0, 1.0, 1.0, 1.0, 1.0)], "approach string, f1 double, auc double, prauc double, recall double, precision double")
    want = sorted([r if r[1] != "z" else ("2-b", "z", "m", 0.11, 0.12, 0.13, 0.14, 0.15) for r in ROWS], key=repr)
    for _ in range(2):
        assert R.update_stored(spark, str(path), new) == ["2-b"]
        assert sorted(map(tuple, R.stored_results(spark, str(path)).collect()), key=repr) == want
        after = files(path)
        assert {f: t for f, t in after.items() if "stage=2-b" not in f} == {f: t for f, t in before.items() if "stage=2-b" not in f}
    assert R.update_stored(spark, str(path), new.where("approach = 'nowhere'")) == [] and files(path) == after
    twice = new.unionByName(new)
    try:
        R.update_stored(spark, str(path), twice)
        raise AssertionError("two updates for one key")
    except Exception as e:  # noqa: BLE001
        assert "more than one update" in str(e)
    assert files(path) == after  # nothing is replaced before all new rows are there


def test_reports_come_out_in_order(spark, tmp_path):
    from patchlens.sources import report as RP
    rows = spark.createDataFrame([(i, f"k{i % 7}{i}", i / 3, f"t{i}") for i in range(200)], "o int, k string, v double, t string").repartition(9)
    sections = [RP.Section("numbers", rows, "k", "v", ord="o", places=2), RP.Section("names", rows.where("o < 20"), "k", text="t", ord="o"),
                RP.facts("facts", rows.agg(F.max("v").alias("a"), F.count("*").alias("n")), {"n": "rows", "a": "largest"}, places=0)]
    want = [f"numbers | k{i % 7}{i} | {i / 3:.2f}" for i in range(200)] + [f"names | k{i % 7}{i} | t{i}" for i in range(20)] + ["facts | rows | 200", "facts | largest | 66"]
    for parts in (1, 4, None):
        RP.render(sections, str(tmp_path / "r"), parts)
        text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
        assert text.splitlines() == want
        if parts == 4:
            assert len(list((tmp_path / "r").glob("part-*"))) > 1
