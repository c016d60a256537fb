"""Driver contract and whole-plan invariants on the smallest data."""
import __spark_entry__ as E
from pyspark.sql import functions as F

from patchlens.operators import filters as P
from patchlens.plans import commits as C
from patchlens.operators.profile import assemble_commits
from patchlens.sources.fixtures import commit_files

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and set(df.columns) >= {"feature", "vuln_mean", "safe_mean", "difference"}


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


def test_waterfall_adds_up(spark):
    raw = assemble_commits(commit_files(spark, SF))
    wf = {r["reason"]: r["n"] for r in P.drop_waterfall(C.prepared(raw)).collect()}
    dropped = sum(v for k, v in wf.items() if k not in ("kept", "original"))
    assert dropped + wf["kept"] == wf["original"]
    assert C.clean_commits(raw).count() == wf["kept"]


def test_query_results_do_not_depend_on_partitioning(spark):
    q = E.queries()["feature_means_by_class"]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    a = sorted(tuple(r) for r in q(spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(tuple(r) for r in q(spark, SF).collect())
    assert a == b
