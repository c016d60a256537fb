"""Split, sampling and set queries (W4-W8, J1, J2, J4, P13) on the whole
function table (label = vul, group = project)."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.operators import sampling as W
from patchlens.sources.fixtures import functions_raw

BASE = O.with_(O.FUNCTIONS_RAW).rstrip() + f""",
labeled AS (SELECT row_id, project, vul AS label FROM functions_raw),
projects AS (SELECT DISTINCT project FROM labeled),
ranked AS (SELECT project, row_number() OVER (ORDER BY {O.md5_key('project')}) AS r,
                  count(*) OVER () AS n FROM projects),
assign AS (SELECT project, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS split
           FROM ranked),
split AS (SELECT l.*, a.split FROM labeled l JOIN assign a ON l.project IS NOT DISTINCT FROM a.project)
"""


def _labeled(spark, sf):
    return functions_raw(spark, sf).select("row_id", "project", F.col("vul").alias("label"))


def _split(spark, sf):
    return W.project_wise_split(_labeled(spark, sf))


@register("project_wise_split", BASE + "SELECT row_id, project, split FROM split")
def project_wise_split(spark, sf):
    """Seeded project order, max(1, int(n*0.25)) projects to test."""
    return _split(spark, sf).select("row_id", "project", "split")


@register("semi_join_projects", BASE + "SELECT row_id FROM labeled WHERE project IN "
          "(SELECT project FROM assign WHERE split = 'test')")
def semi_join_projects(spark, sf):
    """Rows whose project is in the test project set (left semi join)."""
    df = _labeled(spark, sf)
    test_p = W.split_projects(df).filter(F.col("split") == "test")
    return W.semi_join_projects(df, test_p).select("row_id")


@register("anti_join_projects", BASE + "SELECT row_id FROM labeled WHERE project NOT IN "
          "(SELECT project FROM assign WHERE split = 'test')")
def anti_join_projects(spark, sf):
    """The complement (train rows) by left anti join."""
    df = _labeled(spark, sf)
    test_p = W.split_projects(df).filter(F.col("split") == "test")
    return W.anti_join_projects(df, test_p).select("row_id")


@register("split_leak_check", BASE + """SELECT
  (SELECT count(*) FROM (SELECT project FROM split WHERE split = 'train'
                         INTERSECT SELECT project FROM split WHERE split = 'test') x) AS shared_projects,
  (SELECT count(DISTINCT project) FROM split WHERE split = 'test') AS test_projects,
  (SELECT count(DISTINCT project) FROM split WHERE split = 'train') AS train_projects""")
def split_leak_check(spark, sf):
    """J2 check: train and test project sets do not intersect."""
    s = _split(spark, sf)
    tr = s.filter(F.col("split") == "train").select("project")
    te = s.filter(F.col("split") == "test").select("project")
    shared = tr.intersect(te).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return s.agg(F.countDistinct(F.when(F.col("split") == "test", F.col("project"))).alias("test_projects"),
                 F.countDistinct(F.when(F.col("split") == "train", F.col("project"))).alias("train_projects")) \
            .select(F.lit(shared).alias("shared_projects"), "test_projects", "train_projects")


@register("distinct_values", BASE + "SELECT DISTINCT project, label FROM labeled")
def distinct_values(spark, sf):
    """Distinct (project, class) pairs."""
    return _labeled(spark, sf).select("project", "label").distinct()


@register("check_two_classes", BASE + """SELECT split, count(*) AS n_rows, count(DISTINCT label) AS n_classes,
       count(DISTINCT label) >= 2 AS runnable FROM split GROUP BY split""", ints=("runnable",))
def check_two_classes(spark, sf):
    """A split must hold both classes to be evaluated."""
    return _split(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_classes")) \
        .withColumn("runnable", F.col("n_classes") >= 2)


BAL = BASE.rstrip() + f""",
train AS (SELECT * FROM split WHERE split = 'train'),
balanced AS (
  SELECT row_id, label, {O.md5_key('row_id', 43)} AS shuffle_key FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY {O.md5_key('row_id')}, row_id) AS rn FROM train) t
  WHERE rn <= 2500)
"""


def _balanced(spark, sf):
    s = _split(spark, sf).filter(F.col("split") == "train")
    return W.balanced_sample(s, 2500)


@register("balanced_sample", BAL + "SELECT row_id, label, shuffle_key FROM balanced")
def balanced_sample(spark, sf):
    """min(n_c, 2500) hash-chosen train rows per class, shuffled."""
    return _balanced(spark, sf).select("row_id", "label", "shuffle_key")


@register("stratified_split", BASE + f"""SELECT row_id, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {O.md5_key('row_id')}, row_id)
            <= round(count(*) OVER (PARTITION BY label) * 0.15) THEN 'val' ELSE 'train' END AS part
FROM labeled""")
def stratified_split(spark, sf):
    """15% validation rows per class of the whole table."""
    return W.stratified_split(_labeled(spark, sf), 0.15).select("row_id", "label", "part")


@register("capped_sample", BASE + f"""SELECT row_id, label FROM split WHERE split = 'test'
  ORDER BY {O.md5_key('row_id')}, row_id LIMIT 1500""")
def capped_sample(spark, sf):
    """At most 1,500 hash-chosen test rows (exact count)."""
    s = _split(spark, sf).filter(F.col("split") == "test")
    return W.capped_sample(s, 1500).select("row_id", "label")


@register("stratified_kfold", BASE + f"""SELECT row_id, label,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {O.md5_key('row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold
FROM split WHERE split = 'train'""")
def stratified_kfold(spark, sf):
    """5 folds with class shares kept (per-class hash rank mod 5)."""
    s = _split(spark, sf).filter(F.col("split") == "train")
    return W.stratified_kfold(s, 5).select("row_id", "label", "fold")
