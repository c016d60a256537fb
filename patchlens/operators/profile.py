"""Profiling and aggregation.

Each profile is one aggregate (partial aggregation on the map side, a
single tiny result), never a loop of re-scans.  Top-k lists are
``orderBy(...).limit(k)`` (TakeOrderedAndProject: per-task top-k, then a
k-row merge); ties are broken by value ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions import text as T


def _q(c: str):
    return F.col(f"`{c}`")


# A1
def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: position, type, null count; plus row and column counts."""
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.sum(F.when(_q(f.name).isNull(), 1).otherwise(0)).alias(f"_n{i}")
                    for i, f in enumerate(fields)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.coalesce(F.col(f"_n{i}"), F.lit(0)).cast("long").alias("nulls"))
        for i, f in enumerate(fields)]))
    return wide.select(F.col("_rows").alias("n_rows"), F.lit(len(fields)).alias("n_columns"), rows.alias("r")) \
               .select("r.*", "n_rows", "n_columns")


# A2
def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())   # over the per-label rows only
    return counts.select(label, "cnt", (F.col("cnt") * 100.0 / total).alias("pct"))


# A3
def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    agg = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("vulnerable"),
                 F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("safe"))
    return agg.select("vulnerable", "safe",
                      F.floor(F.col("safe") / F.greatest(F.col("vulnerable"), F.lit(1))).cast("long").alias("ratio"))


# A4
def top_values(df: DataFrame, col: str, k: int, out: str = "value") -> DataFrame:
    """``value_counts().head(k)``: nulls excluded, ties by value ascending."""
    return (df.filter(_q(col).isNotNull())
            .groupBy(_q(col).alias(out)).agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col(out).asc()).limit(k))


# A5
def top_projects(df: DataFrame, k: int, project: str = "project", label: str = "label") -> DataFrame:
    """Top k projects by rows, with their vulnerable counts (one group-by)."""
    return (df.filter(F.col(project).isNotNull())
            .groupBy(project).agg(F.count(F.lit(1)).alias("total"),
                                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("vuln"))
            .orderBy(F.col("total").desc(), F.col(project).asc()).limit(k))


# A6
def text_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    wide = df.agg(*[F.count(_q(c)).alias(f"_c{i}") for i, c in enumerate(present)],
                  *[F.avg(F.length(_q(c))).alias(f"_a{i}") for i, c in enumerate(present)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name"),
                 F.col(f"_c{i}").cast("long").alias("non_null"),
                 F.floor(F.col(f"_a{i}")).cast("long").alias("avg_len"))
        for i, c in enumerate(present)]))
    return wide.select(rows.alias("r")).select("r.*")


# A7
# Engine column -> source column checked by the schema audit.
SCHEMA_MAPPING = [
    ("commit_hash", "commit_id"),
    ("commit_message", "commit_message"),
    ("diff", "patch"),
    ("label", "vul"),
    ("files_changed", "files_changed"),
    ("lines_added", "add_lines"),
    ("lines_removed", "del_lines"),
    ("(bonus)", "func_before"),
    ("(bonus)", "CVE ID"),
]


def schema_audit(df: DataFrame, mapping=SCHEMA_MAPPING) -> DataFrame:
    """Expected -> source mapping with FOUND / missing and non-null counts."""
    found = [s for _, s in mapping if s in df.columns]
    wide = df.agg(F.lit(0).alias("_z"), *[F.count(_q(s)).alias(f"_f{i}") for i, s in enumerate(found)])
    idx = {s: i for i, s in enumerate(found)}
    rows = F.explode(F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(y).alias("engine_column"), F.lit(s).alias("source_column"),
                 F.lit("FOUND" if s in idx else "missing").alias("status"),
                 (F.col(f"_f{idx[s]}") if s in idx else F.lit(None)).cast("long").alias("non_null"))
        for o, (y, s) in enumerate(mapping)]))
    return wide.select(rows.alias("r")).select("r.*")


# A8
def sample_row(df: DataFrame, label: str = "vul", order: str = "row_id") -> DataFrame:
    """First vulnerable row with id, project, CWE and a preview."""
    cwe = _q("CWE ID") if "CWE ID" in df.columns else _q("cwe_id")
    return (df.filter(F.col(label) == 1).orderBy(order).limit(1)
            .select(order, "commit_id", "project", cwe.alias("cwe_id"),
                    T.function_preview(F.coalesce(F.col("func_before"), F.lit(""))).alias("preview")))


# A9
def dataset_means(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("lines_added").alias("avg_lines_added"),
                  F.avg("lines_removed").alias("avg_lines_removed"),
                  F.avg("diff_length").alias("avg_diff_length"),
                  F.sum("has_security_terms").cast("long").alias("security_hits"),
                  F.count(F.lit(1)).alias("kept"))


# A12 / S5
def assemble_commits(files: DataFrame) -> DataFrame:
    """(commit, file) rows -> one row per commit.

    ``files_changed`` counts every file; ``diff`` is each non-empty file
    diff followed by a newline, in file order.
    """
    piece = F.when(F.col("diff").isNotNull() & (F.col("diff") != ""),
                   F.struct(F.col("pos"), F.concat(F.col("diff"), F.lit("\n")).alias("d")))
    return (files.groupBy("commit_hash")
            .agg(F.max("commit_message").alias("commit_message"),
                 F.count(F.lit(1)).cast("int").alias("files_changed"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["d"]), "")
                 .alias("diff")))


def nest_commit_files(files: DataFrame) -> DataFrame:
    """Commits with a nested, ordered list of (filename, diff)."""
    return (files.groupBy("commit_hash")
            .agg(F.max("commit_message").alias("commit_message"),
                 F.array_sort(F.collect_list(F.struct("pos", "filename", "diff"))).alias("files")))


def explode_commit_files(nested: DataFrame) -> DataFrame:
    return nested.select("commit_hash", "commit_message", F.explode("files").alias("f")) \
                 .select("commit_hash", "commit_message", "f.pos", "f.filename", "f.diff")
