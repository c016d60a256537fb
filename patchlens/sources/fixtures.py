"""Derived input views.

The engine's inputs are commit tables and a table of functions with their
patches; they are derived here from the given TPC-H style tables so that the
work grows with the data:

* ``functions_raw``   one code-shaped row per order (orders x customer x
                       aggregated line items), schema *function_raw*.
* ``commit_files``    one row per (commit, file) from line items.
* ``commit_raw``      one row per commit: message, file count, joined diff
                       (this is the assembled form, see operators.profile).
* ``scored_rows``     documents x labels with a deterministic score.
* ``text_rows``       documents x labels as a text-classification table.
* ``corpus_rows``     all documents as (row_id, text, project).

All text is assembled in a deterministic order, so results do not depend on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions.text import bound
from patchlens.operators.features import EXPERIMENT_FEATURES
from patchlens.sources.tables import read_table

NL = "\n"


def _line_expr() -> Column:
    pk = F.col("l_partkey")
    ln = F.col("l_linenumber").cast("string")
    sk = F.col("l_suppkey")
    return (F.when(pk % 8 == 0, F.concat(F.lit("  if (p"), ln, F.lit(" > "), sk.cast("string"), F.lit(" && buf) {")))
            .when(pk % 8 == 1, F.lit("  }"))
            .when(pk % 8 == 2, F.concat(F.lit("  memcpy(buf, src, len"), ln, F.lit(");")))
            .when(pk % 8 == 3, F.concat(F.lit("  // part "), (pk % 100).cast("string")))
            .when(pk % 8 == 4, F.lit("  for (i = 0; i < n; i++) {"))
            .when(pk % 8 == 5, F.concat(F.lit("  ptr->f"), (sk % 10).cast("string"), F.lit(" = malloc(n) ? a : b;")))
            .when(pk % 8 == 6, F.lit(""))
            .otherwise(F.lit("  return check_auth(tok);   ")))


def _sign_expr() -> Column:
    rf = F.col("l_returnflag")
    return F.when(rf == "A", F.lit("+")).when(rf == "R", F.lit("-")).otherwise(F.lit(" "))


def _order_key_struct(*extra: Column) -> Column:
    return F.struct(F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"),
                    F.col("l_suppkey").alias("k3"), F.col("l_returnflag").alias("k4"), *extra)


def _texts(lines: Column) -> Column:
    """body and dbody of an order's lines, put together once a row: filters on a text read a finished column."""
    return bound(F.sort_array(lines), lambda xs: F.struct(
        F.array_join(F.transform(xs, lambda x: x["line"]), NL).alias("body"),
        F.array_join(F.transform(xs, lambda x: F.concat(x["sign"], x["line"])), NL).alias("dbody")))


def functions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema *function_raw*: one function (with its patch) per order."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    # Dealt out first: grouped before that, each scan would sort all its line items for nothing.
    items = (li.repartition("l_orderkey").groupBy("l_orderkey")
             .agg(_texts(F.collect_list(_order_key_struct(_line_expr().alias("line"), _sign_expr().alias("sign")))).alias("texts"),
                  F.count(F.lit(1)).alias("n"),
                  F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("n_add"),
                  F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_del")))
    body, dbody = F.col("texts.body"), F.col("texts.dbody")
    # Some patches are long, so that the upper length bounds act.
    dbody = F.when(F.col("o_orderkey") % 53 == 0, F.concat(F.repeat(F.concat(dbody, F.lit(NL)), 39), dbody)).otherwise(dbody)
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    ck = F.col("o_custkey")
    head = (F.when(ck % 4 == 0, F.lit("void fn(void) {" + NL))
            .when(ck % 4 == 1, F.lit("int fn(int a, char *b) {" + NL))
            .when(ck % 4 == 2, F.lit("static int run(struct ctx *c) {" + NL))
            .otherwise(F.lit("Foo::bar(a, b, c)" + NL + "{" + NL)))
    failed = F.col("o_orderstatus") == "F"
    n = F.col("n").cast("string")
    func_before = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string")) \
                   .otherwise(F.concat(head, body, F.lit(NL + "}")))
    prio = F.col("o_orderpriority")
    lang = (F.when(prio == "1-URGENT", "C").when(prio == "2-HIGH", "C++")
            .when(prio == "3-MEDIUM", "C").when(prio == "4-NOT SPECIFIED", "Java")
            .otherwise("Python"))
    joined = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .join(items, F.col("o_orderkey") == F.col("l_orderkey")))
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.md5(ck.cast("string")).alias("commit_id"),
        F.concat(F.lit("proj"), F.col("c_nationkey").cast("string")).alias("project"),
        lang.alias("lang"),
        F.col("n_add").cast("long").alias("add_lines"),
        F.col("n_del").cast("long").alias("del_lines"),
        F.concat(F.lit('{"sha": "'), F.md5(F.col("o_orderkey").cast("string")),
                 F.lit('", "additions": '), F.col("n_add").cast("string"), F.lit("}")).alias("files_changed"),
        F.concat(F.lit("--- a/f.c" + NL + "+++ b/f.c" + NL + "@@ -1,"), n, F.lit(" +1,"), n,
                 F.lit(" @@ fn" + NL), dbody).alias("patch"),
        func_before.alias("func_before"),
        F.when(failed, F.replace(func_before, F.lit("memcpy("), F.lit("memcpy_s("))).otherwise(func_before)
         .alias("func_after"),
        F.when(failed, F.concat(F.lit("CWE-"), (ck % 7).cast("string"))).alias("CWE ID"),
        F.when(failed, F.concat(F.lit("CVE-"), (F.lit(1999) + ck % 20).cast("string"), F.lit("-"),
                                F.col("o_orderkey").cast("string"))).alias("CVE ID"),
        F.when(failed, (ck % 100).cast("double") / 10.0).alias("Score"),
        F.when(failed, 1).otherwise(0).cast("int").alias("vul"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema *commit_files*: (commit_hash, commit_message, pos, filename, diff)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ok = F.col("o_orderkey")
    change = F.concat(_sign_expr(), _line_expr())
    msg = (F.when(ok % 10 == 0, F.lit("Merge branch x"))
           .when(ok % 10 == 1, F.lit("Fix typo in README"))
           .when(ok % 10 == 2, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("Change "), F.col("o_orderpriority"))))
    return (li.join(orders, F.col("l_orderkey") == ok)
            .select(F.md5(F.col("l_orderkey").cast("string")).alias("commit_hash"),
                    msg.alias("commit_message"),
                    F.row_number().over(w).cast("int").alias("pos"),
                    F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".c")).alias("filename"),
                    F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string"))
                     .when(F.col("l_partkey") % 211 == 0, F.concat(F.repeat(F.concat(change, F.lit(NL)), 999), change))
                     .otherwise(change).alias("diff")))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, score): documents x labels, score with ties."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("row_id"),
                    F.col("toxic").cast("int").alias("label"),
                    ((F.col("n_chars") % 101).cast("double") / 100.0).alias("score")))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, project): all documents, labelled or not."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return docs.select(F.col("doc_id").alias("row_id"), "text", F.col("source").alias("project"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, project, label): documents x labels for the text models."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("row_id"), F.col("text"),
                    F.col("source").alias("project"), F.col("toxic").cast("int").alias("label")))


EXPERIMENTS = list(EXPERIMENT_FEATURES)
# Model names of the results table.
MODELS = ["Logistic Regression", "Random Forest"]


def experiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, model, row_id, label, score): one deterministic score per
    (experiment, model) over documents x labels, for the results-table jobs."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    combos = []
    m = 1
    for e in EXPERIMENTS:
        for mo in MODELS:
            m += 2
            combos.append(F.struct(F.lit(e).alias("experiment"), F.lit(mo).alias("model"), F.lit(m).alias("m")))
    j = docs.join(labels, "doc_id").select("doc_id", "n_chars", "toxic", F.explode(F.array(*combos)).alias("c"))
    return j.select("c.experiment", "c.model", F.col("doc_id").alias("row_id"),
                    F.col("toxic").cast("int").alias("label"),
                    (((F.col("n_chars") * F.col("c.m")) % 101).cast("double") / 100.0).alias("score"))
