"""Feature columns of the function table in a single select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T

# The eleven enriched features, in report order.
ENRICHED_FEATURES = [
    "diff_length", "func_before_length",
    "cyclomatic_complexity", "num_parameters",
    "num_function_calls", "nesting_depth",
    "token_diversity", "security_keyword_count",
    "comment_ratio", "lines_added", "lines_removed",
]

#: Those that are taken from the diff.
DIFF_FEATURES = ["diff_length", "lines_added", "lines_removed"]

METRIC_COLUMNS = ["cyclomatic_complexity", "num_parameters", "num_function_calls",
                  "nesting_depth", "token_diversity", "security_keyword_count", "comment_ratio"]


def metric_columns(code_col: str = "func_before") -> list:
    c = F.coalesce(F.col(code_col), F.lit(""))
    return [
        T.cyclomatic_complexity(c).alias("cyclomatic_complexity"),
        T.num_parameters(c).alias("num_parameters"),
        T.num_function_calls(c).alias("num_function_calls"),
        T.nesting_depth(c).alias("nesting_depth"),
        T.token_diversity(c).alias("token_diversity"),
        T.security_keyword_count(c).alias("security_keyword_count"),
        T.comment_ratio(c).alias("comment_ratio"),
    ]


def enrich_all(df: DataFrame, code_col: str = "func_before", diff_col: str | None = "diff",
               keep_raw_counts: bool = True) -> DataFrame:
    """Add all metrics in one projection; without a diff column those of the code.

    ``lines_added`` / ``lines_removed`` are recomputed from the (cleaned)
    diff and overwrite the source counts; with ``keep_raw_counts`` the
    source counts stay available as ``raw_lines_added`` / ``raw_lines_removed``.
    """
    code = F.coalesce(F.col(code_col), F.lit(""))
    # bind the filled text once, then compute every feature off it
    base = df.withColumn(code_col, code)
    if diff_col is not None:
        base = base.withColumn(diff_col, F.coalesce(F.col(diff_col), F.lit("")))
    keep = [c for c in base.columns if c not in set(ENRICHED_FEATURES)]
    raw = []
    if keep_raw_counts:
        for c in ("lines_added", "lines_removed"):
            if c in base.columns:
                raw.append(F.col(c).alias("raw_" + c))
    return base.select(
        *[F.col(f"`{c}`") for c in keep], *raw,
        *([F.length(F.col(diff_col)).cast("long").alias("diff_length")] if diff_col is not None else []),
        F.length(F.col(code_col)).cast("long").alias("func_before_length"),
        *metric_columns(code_col),
        *([T.lines_added(F.col(diff_col)).cast("long").alias("lines_added"),
           T.lines_removed(F.col(diff_col)).cast("long").alias("lines_removed")] if diff_col is not None else []),
    )
