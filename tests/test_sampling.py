"""Splits, ranks, folds, dedup and quotas: exactness and invariants."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from patchlens.operators import sampling as W


def _rows(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 F.concat(F.lit("p"), (F.col("id") % 17).cast("string")).alias("project"))


def test_hash_rank_equals_row_number(spark):
    df = _rows(spark).withColumn("k", W.hash_key("row_id"))
    want = df.withColumn("r2", F.row_number().over(Window.partitionBy("label").orderBy("k", "row_id"))).select("row_id", "r2")
    for bound in (1 << 20, 400, 1):
        got = W.hash_rank(df, "k", by=["label"], tie="row_id", out="r", rank_rows=bound).join(want, "row_id")
        assert got.filter(F.col("r") == F.col("r2")).count() == 2000


def test_prefixes_get_finer_until_they_are_within_the_bound(spark):
    df = _rows(spark).withColumn("k", W.hash_key("row_id"))
    for bound in (5000, 100, 3, 1):
        sizes, digits = W._prefix_sizes(df, "k", ["label"], bound)
        assert sizes.agg(F.max("_n")).first()[0] <= bound and (digits == 0) == (bound >= 2000)
        assert sizes.agg(F.sum("_n")).first()[0] == 2000
    same = df.withColumn("k", F.md5(F.lit("x")))  # equal keys can't be parted, and don't loop
    assert W._prefix_sizes(same, "k", [], 10)[0].agg(F.max("_n")).first()[0] == 2000
    assert W.hash_rank(same, "k", tie="row_id", rank_rows=10).where("rank = row_id + 1").count() == 2000
    assert W.hash_rank(df.limit(0), "k").collect() == []


def test_rows_with_texts_are_ranked_in_smaller_parts(spark, monkeypatch):
    bounds, one = [], W._prefix_sizes
    monkeypatch.setattr(W, "_prefix_sizes", lambda *a: bounds.append(a[-1]) or one(*a))
    monkeypatch.setattr(W, "WIDE_ROWS", 100)
    df = _rows(spark).drop("project")
    plain = W.stratified_kfold(df, 5)
    texts = W.stratified_kfold(df.withColumn("text", F.repeat(F.lit("x"), 50)), 5)
    assert bounds == [W.RANK_ROWS, 100]
    assert texts.drop("text").exceptAll(plain).count() == 0 and texts.count() == 2000
    W.hash_rank(df.select(W.hash_key("row_id").alias("k"), F.col("row_id").cast("string").alias("t")), "k", tie="t")
    assert bounds[-1] == W.RANK_ROWS


def test_shuffle_is_a_permutation_with_ranks(spark):
    got = W.shuffle_rows(_rows(spark, 700)).orderBy("shuffle_rank").collect()
    assert [r["shuffle_rank"] for r in got] == list(range(1, 701)) and [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert [r["row_id"] for r in got] != list(range(700))


def test_stratified_split_of_the_whole_table(spark):
    df = _rows(spark)
    want = {0: round(1333 * 0.15), 1: round(667 * 0.15)}
    for bound in (1 << 20, 50):
        got = W.stratified_split(df, 0.15, rank_rows=bound)
        assert got.count() == 2000
        val = {r["label"]: r["n"] for r in got.where("part = 'val'").groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert val == want


def test_folds_partition_rows_and_keep_shares(spark):
    df = _rows(spark)
    f = W.stratified_kfold(df, 5)
    assert f.count() == df.count()
    per = f.groupBy("fold", "label").count().collect()
    by_label = {}
    for r in per:
        by_label.setdefault(r["label"], []).append(r["count"])
    for counts in by_label.values():
        assert max(counts) - min(counts) <= 1


def test_project_split_no_leak(spark):
    s = W.project_wise_split(_rows(spark))
    tr = s.filter(F.col("split") == "train").select("project").distinct()
    te = s.filter(F.col("split") == "test").select("project").distinct()
    assert tr.intersect(te).count() == 0
    assert te.count() == max(1, int(17 * 0.25))


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, None, 0), (5, None, 0)],
                               "row_id long, text string, label int")
    got = sorted(r[0] for r in W.dedup_keep_first(df, ["text", "label"]).select("row_id").collect())
    assert got == [1, 3, 4]


def test_dedup_groups_numbers_only(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 1700)).alias("text"),
                                    F.lit(1).alias("label"), F.lit("wide").alias("other"))
    out = W.dedup_keep_first(rows, ["text", "label"])
    assert out.columns == rows.columns and out.count() == rows.select("text").distinct().count()
    want = {r["text"]: r["m"] for r in rows.groupBy("text").agg(F.min("row_id").alias("m")).collect()}
    assert {r["text"]: r["row_id"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan


def test_a_digest_collision_keeps_both_rows(spark):
    rows = spark.createDataFrame([(1, "ab", 0), (2, "cd", 0), (3, "ab", 0), (4, "xyz", 0), (5, "xyz", 0), (6, None, 0), (7, "", 0), (8, None, 0), (9, "cd", 1)],
                                 "row_id long, text string, label int")
    weak = lambda keys: [F.coalesce(F.length("text"), F.lit(-1))]
    for digest in (weak, lambda keys: [F.lit(1)], W.digest128):
        got = sorted(r[0] for r in W.dedup_keep_first(rows, ["text", "label"], digest=digest).select("row_id").collect())
        assert got == [1, 2, 4, 6, 7, 9]
    assert W.dedup_keep_first(rows.limit(0), ["text", "label"]).collect() == []


def test_quota_per_class(spark):
    df = _rows(spark, 500)
    q = W.quota_per_class(df, {1: 10, 0: 20})
    got = {r["label"]: sorted(x for x in r["ids"]) for r in
           q.groupBy("label").agg(F.collect_list("row_id").alias("ids")).collect()}
    assert got[1] == [i for i in range(500) if i % 3 == 0][:10]
    assert got[0] == [i for i in range(500) if i % 3 != 0][:20]
