"""Projections, filters, predicates and null handling.

All of these are narrow transformations (no shuffle).  Filters on raw
columns (language, null checks) are pushed into the parquet scan by
Catalyst; length predicates stay above the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T

# Source -> engine column names of the function table.
FUNCTION_COLUMN_MAP = {
    "commit_id": "commit_hash",
    "project": "project",
    "lang": "lang",
    "add_lines": "lines_added",
    "del_lines": "lines_removed",
    "files_changed": "files_changed",
    "patch": "diff",
    "func_before": "func_before",
    "func_after": "func_after",
    "CWE ID": "cwe_id",
    "CVE ID": "cve_id",
    "Score": "cvss_score",
    "vul": "label",
}

# Canonical column order of the cleaned commit table.
COMMIT_COLUMN_ORDER = [
    "commit_hash", "commit_message",
    "author_name", "author_date",
    "files_changed", "lines_added", "lines_removed",
    "diff_length", "has_security_terms",
    "label", "diff",
]

KEEP_LANGS = ["C", "C++"]
FUNCTION_MIN_CHARS = 30
FUNCTION_MAX_CHARS = 5000
COMMIT_MIN_CHARS = 30
COMMIT_MAX_CHARS = 10000

# Null fills of the function table.
FUNCTION_FILLS = {"diff": "", "cwe_id": "Unknown", "cve_id": "N/A", "cvss_score": 0.0}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# P1
def select_rename(df: DataFrame, mapping: dict = FUNCTION_COLUMN_MAP, keep: list[str] | None = None) -> DataFrame:
    """Keep the mapped columns that exist and rename them."""
    cols = [_q(k).alias(v) for k, v in mapping.items() if k in df.columns]
    extra = [_q(c) for c in (keep or []) if c in df.columns]
    return df.select(*extra, *cols)


# P2
def reorder_columns(df: DataFrame, order: list[str] = COMMIT_COLUMN_ORDER) -> DataFrame:
    return df.select(*[_q(c) for c in order if c in df.columns])


# P3
def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default value."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


# P4
def constant_columns(df: DataFrame, constants: dict, drop: list[str] = ()) -> DataFrame:
    df = df.drop(*[c for c in drop if c in df.columns])
    for name, value in constants.items():
        df = df.withColumn(name, F.lit(value))
    return df


# P5
def fill_nulls(df: DataFrame, fills: dict) -> DataFrame:
    present = {k: v for k, v in fills.items() if k in df.columns}
    return df.fillna(present) if present else df


# P6
def filter_lang(df: DataFrame, langs=KEEP_LANGS, col: str = "lang") -> DataFrame:
    return df.filter(F.col(col).isin(list(langs)))


# P7
def filter_not_null(df: DataFrame, cols) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & _q(c).isNotNull()
    return df.filter(cond)


# P8
def function_length_ok(col, lo: int = FUNCTION_MIN_CHARS, hi: int = FUNCTION_MAX_CHARS) -> Column:
    """Raw length within [lo, hi] (functions / patches)."""
    n = F.length(_q(col) if isinstance(col, str) else col)
    return (n >= lo) & (n <= hi)


def filter_length_range(df: DataFrame, col: str, lo: int = FUNCTION_MIN_CHARS,
                        hi: int = FUNCTION_MAX_CHARS) -> DataFrame:
    return df.filter(function_length_ok(col, lo, hi))


def commit_too_short(col) -> Column:
    """Stripped length below the minimum."""
    return F.length(T.py_strip(col)) < COMMIT_MIN_CHARS


def commit_too_long(col) -> Column:
    """Unstripped length above the maximum."""
    return F.length(col) > COMMIT_MAX_CHARS


# P9
def filter_noise_message(df: DataFrame, col: str = "commit_message") -> DataFrame:
    return df.filter(~T.is_noise_message(F.coalesce(F.col(col), F.lit(""))))


# P10
def filter_class(df: DataFrame, label: int, col: str = "label") -> DataFrame:
    return df.filter(F.col(col) == label)


# P6 + P7 + P8 together: the per-chunk row filter of the function table.
def clean_function_rows(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("lang").isin(KEEP_LANGS))
              .filter(F.col("patch").isNotNull() & F.col("func_before").isNotNull())
              .filter(function_length_ok("patch")))


# P11
DROP_RULES = [
    (1, "empty/too-short diff"),
    (2, "diff too large (>10k chars)"),
    (3, "noise commit message"),
]


def drop_reason(diff_col: str = "diff", msg_col: str = "commit_message") -> Column:
    """The first rule that drops a commit row, or 'kept'."""
    diff = F.coalesce(F.col(diff_col), F.lit(""))
    msg = F.coalesce(F.col(msg_col), F.lit(""))
    return (F.when(commit_too_short(diff), F.lit(DROP_RULES[0][1]))
            .when(commit_too_long(diff), F.lit(DROP_RULES[1][1]))
            .when(T.is_noise_message(msg), F.lit(DROP_RULES[2][1]))
            .otherwise(F.lit("kept")))


def drop_waterfall(df: DataFrame) -> DataFrame:
    """Rows per drop reason (zeros included) plus kept and original counts."""
    spark = df.sparkSession
    counts = df.groupBy(drop_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame(
        [(o, r) for o, r in DROP_RULES] + [(4, "kept")], "ord int, reason string")
    per_rule = (F.broadcast(rules).join(counts, "reason", "left")
                .select("ord", "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    total = counts.agg(F.sum("n").cast("long").alias("n")) \
                  .select(F.lit(0).alias("ord"), F.lit("original").alias("reason"), "n")
    return per_rule.unionByName(total)


# P12 / P13
def missing_features(columns: list[str], features: list[str]) -> list[str]:
    return [f for f in features if f not in columns]


def class_count(df: DataFrame, label_col: str = "label") -> Column:
    return F.countDistinct(F.col(label_col))


# P14
def ablation_toggle(df: DataFrame, enabled: bool, text_col: str = "func_before",
                    out: str = "has_security_terms") -> DataFrame:
    return df.withColumn(out, T.has_security_terms(F.col(text_col), T.FUNCTION_SECURITY_TERMS, enabled))
