"""Function table: raw -> ready -> enriched, as one lazy plan.

scan (pushed-down language / null filters) -> length filter -> select/rename ->
keep-first dedup on (function text, label) -> null fills -> patch cleaning ->
features -> seeded shuffle order. A per-class quota is applied only where a
caller asks for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.functions.enrich import DIFF_FEATURES, enrich_all
from patchlens.operators import filters as P
from patchlens.operators import sampling as W
from patchlens.session import materialize

#: Default quota of the quota operator itself; no other step applies it.
QUOTAS = {1: 3000, 0: 6000}
CHUNK_SIZE = 2000
SEED = 42


def collected_rows(raw: DataFrame, quotas: dict | None = None) -> DataFrame:
    """Rows of either class that pass the row filter; with quotas the first ones per class in file order."""
    rows = P.clean_function_rows(raw)
    if quotas is None:
        return rows.where(F.col("vul").isin(0, 1))
    return W.quota_per_class(rows, quotas, label="vul", order="row_id")


def ready(raw: DataFrame, quotas: dict | None = None, use_security_terms: bool = True,
          shuffle: bool = False, columns: list[str] | None = None, diff: bool = True) -> DataFrame:
    """Schema *function_ready* (plus ``row_id``); with ``columns`` only those of the collected ones and what the steps here read.

    Without ``diff`` the patch, by far the longest column, is filtered by and then neither stored nor cleaned.
    """
    df = P.select_rename(collected_rows(raw, quotas), keep=["row_id"])
    df = P.constant_columns(df, {"files_changed": 1}, drop=["files_changed"])
    if columns is not None:
        df = df.select("row_id", *[c for c in df.columns if c in {*columns, "diff", "func_before", "label"}])
    if not diff:
        df = df.drop("diff")
    # Read twice by the dedup, by its key columns and whole: stored, the filters and joins behind it run once.
    df = W.dedup_keep_first(materialize(df), ["func_before", "label"], order="row_id")
    df = P.fill_nulls(df, P.FUNCTION_FILLS)
    if diff:
        df = df.withColumn("diff", T.clean_patch(F.col("diff"))).withColumn("diff_length", F.length("diff").cast("long"))
    df = (df.withColumn("func_before_length", F.length("func_before").cast("long"))
            .withColumn("has_security_terms",
                        T.has_security_terms(F.col("func_before"), T.FUNCTION_SECURITY_TERMS,
                                             use_security_terms)))
    if shuffle:
        df = W.shuffle_rows(df, SEED)
    return df


def enriched(raw: DataFrame, quotas: dict | None = None, columns: list[str] | None = None, features: list[str] | None = None) -> DataFrame:
    """Schema *function_enriched*: ready + the seven code metrics, with the
    diff line counts recomputed from the cleaned diff. ``columns`` as in ``ready``; with ``features`` none of which
    is the diff's, the diff and its features are left out."""
    diff = features is None or bool(set(features) & set(DIFF_FEATURES))
    return enrich_all(ready(raw, quotas, columns=columns, diff=diff), "func_before", "diff" if diff else None)


def feature_means_by_class(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per feature: mean over label 1, mean over label 0, difference, direction.

    One pass: conditional averages in a single global aggregate, then unpivot.
    """
    aggs = []
    for f in features:
        aggs.append(F.avg(F.when(F.col(label) == 1, F.col(f))).alias(f"v__{f}"))
        aggs.append(F.avg(F.when(F.col(label) == 0, F.col(f))).alias(f"s__{f}"))
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"),
                 F.col(f"v__{f}").cast("double").alias("vuln_mean"),
                 F.col(f"s__{f}").cast("double").alias("safe_mean"))
        for i, f in enumerate(features)]))
    out = wide.select(rows.alias("r")).select("r.*")
    d = F.col("vuln_mean") - F.col("safe_mean")
    return out.select("ord", "feature", "vuln_mean", "safe_mean", d.alias("difference"),
                      F.when(d > 0, "up").otherwise("down").alias("direction"))


def funnel_counts(raw: DataFrame, quotas: dict = QUOTAS, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Rows seen -> vulnerable collected -> safe collected -> after dedup.

    "Rows seen" reproduces a chunked reader that stops once both quotas are
    full: it counts whole chunks up to the one in which the last quota
    filled, plus the chunk read before the stop is noticed; all rows if a
    quota never fills.  Chunks are consecutive row positions in ``row_id``
    order; the position of the filling row is a count, not a window.
    """
    total = raw.agg(F.count(F.lit(1)).alias("total"))
    cut = W.quota_cutoffs(P.clean_function_rows(raw), quotas, label="vul", order="row_id")
    per = cut.agg(*[F.max(F.when(F.col("vul") == c, F.col("collected"))).alias(f"c{c}") for c in quotas],
                  *[F.max(F.when(F.col("vul") == c, F.col("last_row_id"))).alias(f"l{c}") for c in quotas])
    full = F.lit(True)
    for c, q in quotas.items():
        full = full & (F.coalesce(F.col(f"c{c}"), F.lit(0)) >= q)
    last = F.greatest(*[F.col(f"l{c}") for c in quotas])
    stop = per.select(F.when(full, last)).scalar()                  # scalar subquery
    n_total = total.select("total").scalar()
    pos = raw.agg(F.sum(F.when(F.col("row_id") <= stop, 1).otherwise(0)).alias("pos"))
    seen = pos.select(F.when(stop.isNull(), n_total)
                      .otherwise(F.least(n_total, (F.ceil(F.col("pos") / chunk_size) + 1) * chunk_size))
                      .cast("long").alias("n"))
    dedup = ready(raw, quotas).agg(F.count(F.lit(1)).cast("long").alias("n"))
    vul = per.select(F.coalesce(F.col("c1"), F.lit(0)).cast("long").alias("n"))
    safe = per.select(F.coalesce(F.col("c0"), F.lit(0)).cast("long").alias("n"))
    parts = [(1, "rows_seen", seen), (2, "vulnerable_collected", vul),
             (3, "safe_collected", safe), (4, "after_dedup", dedup)]
    return reduce_union([p.select(F.lit(o).alias("ord"), F.lit(s).alias("stage"), "n") for o, s, p in parts])


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
