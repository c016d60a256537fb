"""Commit path: (commit, file) rows -> commits -> drop waterfall -> features
-> cleaned diff, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators import filters as P
from patchlens.operators.profile import assemble_commits

AUTHOR_DEFAULTS = {"author_name": "unknown", "author_date": ""}


def prepared(commit_raw: DataFrame) -> DataFrame:
    """Null text filled, author placeholders added, drop reason attached."""
    df = (commit_raw.withColumn("diff", F.coalesce(F.col("diff"), F.lit("")))
          .withColumn("commit_message", F.coalesce(F.col("commit_message"), F.lit(""))))
    df = P.ensure_columns(df, AUTHOR_DEFAULTS)
    return df.withColumn("drop_reason", P.drop_reason())


def clean_commits(commit_raw: DataFrame) -> DataFrame:
    """Schema *commit_clean*.

    Line counts, length and the keyword flag are taken from the diff before
    cleaning; the diff column is then replaced by its cleaned text.
    """
    df = prepared(commit_raw).filter(F.col("drop_reason") == "kept").drop("drop_reason")
    df = (df.withColumn("lines_added", T.lines_added(F.col("diff")))
            .withColumn("lines_removed", T.lines_removed(F.col("diff")))
            .withColumn("diff_length", F.length("diff"))
            .withColumn("has_security_terms", T.has_security_terms(F.col("diff"), T.COMMIT_SECURITY_TERMS)))
    df = P.ensure_columns(df, {"files_changed": 0})
    df = df.withColumn("label", F.lit(0))
    df = df.withColumn("diff", T.clean_diff(F.col("diff")))
    return P.reorder_columns(df)


def clean_from_files(files: DataFrame) -> DataFrame:
    return clean_commits(assemble_commits(files))
