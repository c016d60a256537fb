"""Function-table queries: row filter, quota, dedup, fills, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.functions import text as T
from patchlens.functions.enrich import ENRICHED_FEATURES, enrich_all
from patchlens.operators import filters as P
from patchlens.operators import sampling as W
from patchlens.plans import preprocess as PP
from patchlens.sources.fixtures import functions_raw

# ---------------------------------------------------------------------------
# SQL building blocks for the prep chain
# ---------------------------------------------------------------------------

ROW_FILTER_SQL = ("lang IN ('C', 'C++') AND patch IS NOT NULL AND func_before IS NOT NULL "
                  "AND length(patch) >= 30 AND length(patch) <= 5000")

COLLECTED = f"""
collected AS (SELECT * FROM functions_raw WHERE {ROW_FILTER_SQL} AND vul IN (0, 1))"""

# Quotas of the registered quota queries: below the sizes of both classes on
# every given scale factor from 0.01 on, so that they act.
QUOTAS = {1: 2000, 0: 4000}

LIMITED = f"""
collected AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY vul ORDER BY row_id) AS rn
    FROM functions_raw WHERE {ROW_FILTER_SQL} AND vul IN (0, 1)) t
  WHERE (vul = 1 AND rn <= {QUOTAS[1]}) OR (vul = 0 AND rn <= {QUOTAS[0]}))"""

RENAME_SELECT = """row_id, commit_id AS commit_hash, project, lang, add_lines AS lines_added,
       del_lines AS lines_removed, patch AS diff, func_before, func_after, "CWE ID" AS cwe_id,
       "CVE ID" AS cve_id, "Score" AS cvss_score, vul AS label"""

READY = f"""
renamed AS (SELECT {RENAME_SELECT}, 1 AS files_changed FROM collected),
deduped AS (
  SELECT * FROM renamed
  QUALIFY row_number() OVER (PARTITION BY func_before, label ORDER BY row_id) = 1),
ready0 AS (
  SELECT row_id, commit_hash, project, lang, lines_added, lines_removed,
         {O.clean_patch("coalesce(diff, '')")} AS diff,
         func_before, func_after, coalesce(cwe_id, 'Unknown') AS cwe_id, coalesce(cve_id, 'N/A') AS cve_id,
         coalesce(cvss_score, 0.0) AS cvss_score, label, files_changed
  FROM deduped),
ready AS (
  SELECT *, CAST(length(diff) AS BIGINT) AS diff_length,
         CAST(length(func_before) AS BIGINT) AS func_before_length,
         {O.has_security_terms("func_before")} AS has_security_terms
  FROM ready0)"""


def enrich_select(src: str, code: str = "func_before", diff: str = "diff", keep: str = "*") -> str:
    return f"""
  SELECT {keep},
         CAST(length({diff}) AS BIGINT) AS diff_length,
         CAST(length({code}) AS BIGINT) AS func_before_length,
         {O.cyclomatic(code)} AS cyclomatic_complexity,
         {O.num_parameters(code)} AS num_parameters,
         {O.num_function_calls(code)} AS num_function_calls,
         {O.nesting_depth(code)} AS nesting_depth,
         {O.token_diversity(code)} AS token_diversity,
         {O.keyword_count(code)} AS security_keyword_count,
         {O.comment_ratio(code)} AS comment_ratio,
         {O.lines_added(diff)} AS lines_added,
         {O.lines_removed(diff)} AS lines_removed
  FROM {src}"""


ENRICHED = f"""
enriched AS ({enrich_select("ready", keep="* EXCLUDE (diff_length, func_before_length, lines_added, lines_removed), "
                                          "lines_added AS raw_lines_added, lines_removed AS raw_lines_removed")})"""

PREP_CTES = O.with_(O.FUNCTIONS_RAW, COLLECTED, READY, ENRICHED)
LIMITED_CTES = O.with_(O.FUNCTIONS_RAW, LIMITED, READY)


def class_means_sql(src: str, features: list[str]) -> str:
    parts = []
    for i, f in enumerate(features):
        parts.append(f"SELECT CAST({i} AS BIGINT) AS ord, '{f}' AS feature, "
                     f"avg(CASE WHEN label = 1 THEN {f} END) AS vuln_mean, "
                     f"avg(CASE WHEN label = 0 THEN {f} END) AS safe_mean FROM {src}")
    return ("SELECT ord, feature, vuln_mean, safe_mean, vuln_mean - safe_mean AS difference, "
            "CASE WHEN vuln_mean - safe_mean > 0 THEN 'up' ELSE 'down' END AS direction FROM (\n"
            + "\nUNION ALL\n".join(parts) + ") m")


MEANS_DOUBLES = ("vuln_mean", "safe_mean", "difference")

# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------


def _enriched(spark, sf):
    return PP.enriched(functions_raw(spark, sf))


@register("feature_means_by_class", PREP_CTES + class_means_sql("enriched", ENRICHED_FEATURES),
          doubles=MEANS_DOUBLES)
def feature_means_by_class(spark, sf):
    """A10: per-feature class means over the enriched function table."""
    return PP.feature_means_by_class(_enriched(spark, sf), ENRICHED_FEATURES)


ENRICHED_OUT = ["row_id", "label", "diff_length", "func_before_length", "cyclomatic_complexity",
                "num_parameters", "num_function_calls", "nesting_depth", "token_diversity",
                "security_keyword_count", "comment_ratio", "lines_added", "lines_removed",
                "raw_lines_added", "raw_lines_removed", "has_security_terms"]


@register("enrich_ready", PREP_CTES + f"SELECT {', '.join(ENRICHED_OUT)} FROM enriched",
          doubles=("token_diversity", "comment_ratio"))
def enrich_ready(spark, sf):
    """T15 on the preprocessed table: the enrichment stage."""
    return _enriched(spark, sf).select(*ENRICHED_OUT)


WHOLE = f"""
whole AS (
  SELECT row_id, vul AS label, coalesce(func_before, '') AS func_before,
         {O.clean_patch("coalesce(patch, '')")} AS diff, add_lines AS raw_lines_added,
         del_lines AS raw_lines_removed FROM functions_raw)"""
WHOLE_OUT = [c for c in ENRICHED_OUT if c != "has_security_terms"]


def _whole(spark, sf):
    raw = functions_raw(spark, sf)
    df = raw.select("row_id", F.col("vul").alias("label"), "func_before",
                    T.clean_patch(F.coalesce(F.col("patch"), F.lit(""))).alias("diff"),
                    F.col("add_lines").alias("lines_added"), F.col("del_lines").alias("lines_removed"))
    return enrich_all(df)


@register("enrich_all",
          O.with_(O.FUNCTIONS_RAW, WHOLE, "enriched AS (" + enrich_select("whole", keep="row_id, label, "
                  "raw_lines_added, raw_lines_removed") + ")") + f"SELECT {', '.join(WHOLE_OUT)} FROM enriched",
          doubles=("token_diversity", "comment_ratio"))
def enrich_all_q(spark, sf):
    """Every metric for every function row, one projection."""
    return _whole(spark, sf).select(*WHOLE_OUT)


@register("scan_partitioned",
          O.with_(O.FUNCTIONS_RAW) + f"SELECT row_id, commit_id, project, lang, vul, length(patch) AS patch_len "
          f"FROM functions_raw WHERE {ROW_FILTER_SQL}", ints=("patch_len",))
def scan_partitioned(spark, sf):
    """S3: the chunked row filter as one partitioned scan (same rows)."""
    df = P.clean_function_rows(functions_raw(spark, sf))
    return df.select("row_id", "commit_id", "project", "lang", "vul", F.length("patch").alias("patch_len"))


@register("filter_lang", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id, lang FROM functions_raw WHERE lang IN ('C', 'C++')")
def filter_lang(spark, sf):
    """Keep C and C++ rows."""
    return P.filter_lang(functions_raw(spark, sf)).select("row_id", "lang")


@register("filter_not_null", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id FROM functions_raw WHERE patch IS NOT NULL AND func_before IS NOT NULL")
def filter_not_null(spark, sf):
    """Patch and function present."""
    return P.filter_not_null(functions_raw(spark, sf), ["patch", "func_before"]).select("row_id")


@register("filter_length_range", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id, CAST(length(patch) AS BIGINT) AS patch_len FROM functions_raw "
          "WHERE length(patch) BETWEEN 30 AND 5000")
def filter_length_range(spark, sf):
    """P8 (functions): raw patch length within [30, 5000] inclusive."""
    df = P.filter_length_range(functions_raw(spark, sf), "patch", 30, 5000)
    return df.select("row_id", F.length("patch").cast("long").alias("patch_len"))


@register("filter_class", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id, project FROM functions_raw WHERE vul = 1")
def filter_class(spark, sf):
    """P10: the vulnerable rows."""
    return P.filter_class(functions_raw(spark, sf), 1, "vul").select("row_id", "project")


@register("select_rename", O.with_(O.FUNCTIONS_RAW) + f"SELECT {RENAME_SELECT} FROM functions_raw",
          doubles=("cvss_score",))
def select_rename(spark, sf):
    """Keep mapped columns and rename them."""
    return P.select_rename(functions_raw(spark, sf), keep=["row_id"]).drop("files_changed")


@register("constant_columns", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id, 1 AS files_changed, 0 AS placeholder_label FROM functions_raw")
def constant_columns(spark, sf):
    """Drop the JSON ``files_changed`` and set the proxy 1; placeholder label 0."""
    df = P.constant_columns(functions_raw(spark, sf).select("row_id", "files_changed"),
                            {"files_changed": 1, "placeholder_label": 0}, drop=["files_changed"])
    return df


@register("fill_nulls", O.with_(O.FUNCTIONS_RAW) +
          f"SELECT row_id, coalesce(patch, '') AS diff, coalesce(\"CWE ID\", 'Unknown') AS cwe_id, "
          f"coalesce(\"CVE ID\", 'N/A') AS cve_id, coalesce(\"Score\", 0.0) AS cvss_score FROM functions_raw",
          doubles=("cvss_score",))
def fill_nulls(spark, sf):
    """P5: per-column null fills."""
    df = P.select_rename(functions_raw(spark, sf), keep=["row_id"])
    return P.fill_nulls(df, P.FUNCTION_FILLS).select("row_id", "diff", "cwe_id", "cve_id", "cvss_score")


@register("ablation_toggle", O.with_(O.FUNCTIONS_RAW) +
          f"SELECT row_id, {O.has_security_terms('func_before')} AS has_security_terms, "
          f"0 AS has_security_terms_off FROM functions_raw WHERE func_before IS NOT NULL")
def ablation_toggle(spark, sf):
    """Keyword feature on, and forced to 0."""
    df = P.filter_not_null(functions_raw(spark, sf), ["func_before"])
    on = P.ablation_toggle(df, True)
    return P.ablation_toggle(on, False, out="has_security_terms_off").select(
        "row_id", "has_security_terms", "has_security_terms_off")


@register("quota_per_class", O.with_(O.FUNCTIONS_RAW, LIMITED) + "SELECT row_id, vul FROM collected")
def quota_per_class(spark, sf):
    """The first rows of each class in file order, up to the class's quota."""
    return PP.collected_rows(functions_raw(spark, sf), QUOTAS).select("row_id", "vul")


@register("dedup_keep_first", O.with_(O.FUNCTIONS_RAW) +
          "SELECT row_id, vul FROM functions_raw "
          "QUALIFY row_number() OVER (PARTITION BY func_before, vul ORDER BY row_id) = 1")
def dedup_keep_first(spark, sf):
    """Drop later copies of (function text, label), whole table."""
    return W.dedup_keep_first(functions_raw(spark, sf), ["func_before", "vul"]).select("row_id", "vul")


@register("shuffle_rows", PREP_CTES + f"SELECT row_id, {O.md5_key('row_id')} AS shuffle_key, "
          f"row_number() OVER (ORDER BY {O.md5_key('row_id')}, row_id) AS shuffle_rank FROM ready", ints=("shuffle_rank",))
def shuffle_rows(spark, sf):
    """Seeded permutation of the ready table: hash order and place."""
    return W.shuffle_rows(PP.ready(functions_raw(spark, sf)).select("row_id")).select("row_id", "shuffle_key", "shuffle_rank")


FUNNEL_SQL = LIMITED_CTES.rstrip() + f""",
flt AS (SELECT row_id, vul, row_number() OVER (PARTITION BY vul ORDER BY row_id) AS rn
        FROM functions_raw WHERE {ROW_FILTER_SQL} AND vul IN (0, 1)),
per AS (SELECT max(CASE WHEN vul = 1 AND rn <= {QUOTAS[1]} THEN rn END) AS c1,
               max(CASE WHEN vul = 0 AND rn <= {QUOTAS[0]} THEN rn END) AS c0,
               max(CASE WHEN vul = 1 AND rn = {QUOTAS[1]} THEN row_id END) AS l1,
               max(CASE WHEN vul = 0 AND rn = {QUOTAS[0]} THEN row_id END) AS l0 FROM flt),
stop AS (SELECT CASE WHEN l1 IS NOT NULL AND l0 IS NOT NULL THEN greatest(l1, l0) END AS stop_row_id FROM per),
seen AS (SELECT CASE WHEN s.stop_row_id IS NULL THEN (SELECT count(*) FROM functions_raw)
                     ELSE least((SELECT count(*) FROM functions_raw),
                                (ceil((SELECT count(*) FROM functions_raw f WHERE f.row_id <= s.stop_row_id)
                                      / {PP.CHUNK_SIZE}) + 1) * {PP.CHUNK_SIZE}) END AS n FROM stop s)
SELECT 1 AS ord, 'rows_seen' AS stage, n FROM seen
UNION ALL SELECT 2, 'vulnerable_collected', coalesce(c1, 0) FROM per
UNION ALL SELECT 3, 'safe_collected', coalesce(c0, 0) FROM per
UNION ALL SELECT 4, 'after_dedup', (SELECT count(*) FROM ready)
"""


@register("funnel_counts", FUNNEL_SQL, ints=("ord", "n"))
def funnel_counts(spark, sf):
    """Rows seen, collected per class, after dedup."""
    return PP.funnel_counts(functions_raw(spark, sf), QUOTAS)


@register("union_parts", O.with_(O.FUNCTIONS_RAW, LIMITED) + "SELECT row_id, vul AS label FROM collected")
def union_parts(spark, sf):
    """Vulnerable part then safe part as one frame (unionByName)."""
    rows = PP.collected_rows(functions_raw(spark, sf), QUOTAS).select("row_id", F.col("vul").alias("label"))
    return rows.where("label = 1").unionByName(rows.where("label = 0"))
