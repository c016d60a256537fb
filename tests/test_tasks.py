"""Sizes of tasks: bounded by settings from the input's bytes, cells explained once, fits dealt over the cores."""
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from patchlens.operators import explain as X
from patchlens.operators import ml as ML
from patchlens.operators import trees as TR
from patchlens.session import TASK_BYTES, size_tasks


def test_partitions_follow_the_bytes_of_the_input(spark, tmp_path):
    names = [f"spark.sql.{x}" for x in ("adaptive.coalescePartitions.initialPartitionNum", "adaptive.advisoryPartitionSizeInBytes",
                                        "files.maxPartitionBytes")]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        Path(tmp_path, "t.parquet").write_bytes(b"x" * (600 << 20))
        size_tasks(spark, str(tmp_path))
        assert int(spark.conf.get(names[0])) >= 600
        assert int(spark.conf.get(names[1])[:-1]) <= TASK_BYTES
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _tree():
    nodes = {0: (1, 2, 0, 0.5, (6.0, 4.0)), 1: (-1, -1, -1, 0.0, (5.0, 1.0)), 2: (3, 4, 1, 2.0, (1.0, 3.0)),
             3: (-1, -1, -1, 0.0, (1.0, 0.0)), 4: (-1, -1, -1, 0.0, (0.0, 3.0))}
    return TR.leaves_of(nodes, 2, 1)


def test_rows_of_one_cell_are_explained_once(monkeypatch):
    sizes, one = [], TR._explain_cells
    monkeypatch.setattr(TR, "_explain_cells", lambda trees, cuts, at: sizes.append(len(at)) or one(trees, cuts, at))
    x = np.array([[0.1, 9.0], [0.5, 3.0], [0.6, 2.0], [0.7, -1.0], [np.nan, np.nan], [-np.inf, np.inf]])
    phi = TR.explain([_tree()], np.repeat(x, 50, axis=0))
    assert sizes == [3]
    prob = np.array([1 / 6, 1 / 6, 0, 0, 1, 1 / 6])
    assert np.allclose(_tree().expected + phi.sum(axis=1), np.repeat(prob, 50))


def test_sampled_states_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(X, "STATES", 100)
    rows = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    out = X.sampled_shap(rows, ["a", "b"], rows.limit(5).select("a", "b"), lambda d: d.withColumn("prob", F.col("a") + F.col("b")), n_perm=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(row_id") == 1
    assert out.count() == 80


def test_rows_of_a_fit_are_dealt_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100, numPartitions=1)
    assert ML.dealt(rows, 100).rdd.getNumPartitions() == 1
    assert ML.dealt(rows, cores * ML.DEALT_ROWS).rdd.getNumPartitions() == cores


def test_line_items_are_dealt_out_before_they_are_grouped(spark):
    from patchlens.sources.fixtures import functions_raw
    plan = functions_raw(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [i for i, line in enumerate(plan) if "collect_list" in line]
    assert "REPARTITION_BY_COL" in "".join(plan) and depth[-1] < next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)


def test_a_forest_keeps_its_rows_nodes_and_its_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                   ((F.col("id") * 13 % 17) > 8).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).repartition(2).cache()
    kept = ML.forest(n_trees=5, depth=4)
    assert kept.getCacheNodeIds() and kept.getCheckpointInterval() == -1
    walked = ML.forest(n_trees=5, depth=4).setCacheNodeIds(False)
    a, b = (e.fit(rows).toDebugString.split("\n", 1)[1] for e in (kept, walked))
    assert a == b


def test_lines_and_tokens_are_computed_once_a_row(spark):
    from patchlens.functions import text as T
    texts = ["", "\n", " // a\n　* b\n\x1c/* c\n/ d\nx // e\n", "*\r\n  \t//", "a b a", None, " \n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def of(column, word):
        out = df.select("i", column.alias("v"))
        assert out._jdf.queryExecution().analyzed().toString().count(word) == 1
        return [r["v"] for r in out.orderBy("i").collect()]

    lines = [t and t.splitlines() for t in texts]
    assert of(T.py_lines("t"), "split(") == [[] if t == "" else x for t, x in zip(texts, lines)]
    starts = [x and [y.strip().startswith(("//", "*", "/*")) for y in x] for x in lines]
    assert of(T.comment_ratio("t"), "split(")[:5] == [sum(x) / len(x) if x else 0.0 for x in starts[:5]]
    assert of(T.token_diversity("t"), "regexp_extract_all(") == [0.0, 0.0, 1.0, 0.0, 2 / 3, None, 0.0]


def test_features_store_only_the_columns_they_need(spark, monkeypatch):
    from patchlens.plans import preprocess as PP
    from patchlens.sources.fixtures import functions_raw
    stored, one = [], PP.materialize
    monkeypatch.setattr(PP, "materialize", lambda df: stored.append(df.columns) or one(df))
    raw = functions_raw(spark, "/root/testdata/sf0.001").where("row_id < 400")
    few, whole = PP.enriched(raw, columns=["project"]), PP.enriched(raw)
    assert stored[0] == ["row_id", "project", "diff", "func_before", "label"] and "func_after" in stored[1]
    assert few.exceptAll(whole.select(few.columns)).count() == 0 and few.count() == whole.count()
