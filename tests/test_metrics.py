"""Metric operators: golden counts and brute-force comparisons."""
import random

from pyspark.sql import functions as F

from patchlens.operators import metrics as M


def test_golden_prf(spark):
    # TP=275 FP=463 FN=117 TN=990 -> P 0.3726, R 0.7015, F1 0.4867
    df = spark.createDataFrame([(275, 463, 117, 990)], "tp long, fp long, fn long, tn long")
    r = df.select(*M.prf_columns()).first()
    assert round(r["precision"], 4) == 0.3726 and round(r["recall"], 4) == 0.7015 and round(r["f1"], 4) == 0.4867


def _brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ths = sorted({s for s, _ in rows}, reverse=True)
    ap, prev_r = 0.0, 0.0
    best = (-1.0, None)
    for t in ths:
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        p, r = tp / (tp + fp), tp / len(pos)
        ap += (r - prev_r) * p
        prev_r = r
        f1 = 0.0 if p + r == 0 else 2 * p * r / (p + r)
        if f1 > best[0] or (f1 == best[0] and t < best[1]):
            best = (f1, t)
    return auc, ap, best


def test_ranking_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame([(i, y, s) for i, (s, y) in enumerate(rows)], "row_id long, label int, score double")
    auc, ap, (f1, t) = _brute(rows)
    for range_rows in (1000, 30, 2):
        rk = M.ranking_metrics(df, range_rows=range_rows).first()
        assert abs(rk["auc"] - auc) < 1e-9 and abs(rk["prauc"] - ap) < 1e-9
    bt = M.best_threshold(df).first()
    assert abs(bt["threshold"] - t) < 1e-12 and abs(bt["f1"] - f1) < 1e-9


def test_metrics_invariant_under_repartition(spark):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.4), round(rnd.random(), 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, label int, score double")
    a = M.metrics_at_thresholds(df).orderBy("kind").collect()
    b = M.metrics_at_thresholds(df.repartition(7, "score")).orderBy("kind").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_ranges_follow_the_number_of_scores(spark):
    rnd = random.Random(11)
    for n, most in ((400, 1), (4000, 4), (20000, 20)):
        rows = [(rnd.random(), int(rnd.random() < 0.3)) for _ in range(n)]
        df = spark.createDataFrame(rows, "score double, label int")
        counts = M.stored_counts(df)
        ranged = M.ranged(counts, 1000).groupBy("_b").agg(F.count("*").alias("n")).collect()
        assert len(ranged) >= 0.9 * most and (most == 1 or max(r["n"] for r in ranged) < 3000)
        cum = {r["s"]: (r["tp"], r["fp"]) for r in M.cumulative_desc(counts, 1000).collect()}
        tp = fp = 0
        for s, y in sorted(rows, reverse=True):
            tp, fp = tp + y, fp + 1 - y
            assert cum[s] == (tp, fp)


def test_groups_have_their_own_sums(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice(["a", "b", None]), round(rnd.random(), 2), int(rnd.random() < 0.5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for range_rows in (1 << 20, 20):
        got = {r["g"]: r for r in M.ranking_metrics(df, range_rows=range_rows, by=["g"]).collect()}
        for g in ("a", "b", None):
            auc, ap, _ = _brute([(s, y) for h, s, y in rows if h == g])
            assert abs(got[g]["auc"] - auc) < 1e-9 and abs(got[g]["prauc"] - ap) < 1e-9
