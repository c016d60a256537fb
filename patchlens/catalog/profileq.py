"""Profiling queries over the whole function table."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.catalog.prep import PREP_CTES
from patchlens.operators import profile as A
from patchlens.plans import preprocess as PP
from patchlens.sources.fixtures import functions_raw

FX = O.with_(O.FUNCTIONS_RAW)
PREFIX_ROWS = 5000

# Fixed: the Spark simple-string type of each raw column, in column order.
RAW_TYPES = [("row_id", "bigint"), ("commit_id", "string"), ("project", "string"), ("lang", "string"),
             ("add_lines", "bigint"), ("del_lines", "bigint"), ("files_changed", "string"),
             ("patch", "string"), ("func_before", "string"), ("func_after", "string"),
             ("CWE ID", "string"), ("CVE ID", "string"), ("Score", "double"), ("vul", "int")]


def _profile_sql() -> str:
    parts = [f"SELECT {i} AS ord, '{c}' AS column_name, '{t}' AS dtype, "
             f"count(*) - count(\"{c}\") AS nulls, count(*) AS n_rows, {len(RAW_TYPES)} AS n_columns "
             f"FROM functions_raw" for i, (c, t) in enumerate(RAW_TYPES)]
    return FX + "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql(), ints=("ord", "nulls", "n_rows", "n_columns"))
def profile_columns(spark, sf):
    """A1: per column type and null count, with row and column counts."""
    return A.profile_columns(functions_raw(spark, sf))


@register("label_distribution", FX + """SELECT vul, count(*) AS cnt,
       count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM functions_raw GROUP BY vul""",
          ints=("vul", "cnt"), doubles=("pct",))
def label_distribution(spark, sf):
    """A2: count and percentage per label."""
    return A.label_distribution(functions_raw(spark, sf), "vul")


@register("imbalance_ratio", FX + """SELECT vulnerable, safe, CAST(floor(safe / greatest(vulnerable, 1)) AS BIGINT)
       AS ratio FROM (SELECT CAST(sum(CASE WHEN vul = 1 THEN 1 ELSE 0 END) AS BIGINT) AS vulnerable,
                             CAST(sum(CASE WHEN vul = 0 THEN 1 ELSE 0 END) AS BIGINT) AS safe
                      FROM functions_raw) t""")
def imbalance_ratio(spark, sf):
    """A3: safe // max(vulnerable, 1)."""
    return A.imbalance_ratio(functions_raw(spark, sf), "vul")


@register("top_cwe", FX + """SELECT "CWE ID" AS value, count(*) AS cnt FROM functions_raw
  WHERE vul = 1 AND "CWE ID" IS NOT NULL GROUP BY "CWE ID" ORDER BY cnt DESC, value ASC LIMIT 8""")
def top_cwe(spark, sf):
    """A4: top 8 CWE ids among vulnerable rows (nulls excluded)."""
    return A.top_values(functions_raw(spark, sf).filter(F.col("vul") == 1), "CWE ID", 8)


@register("top_cwe_ready", PREP_CTES + """SELECT cwe_id AS value, count(*) AS cnt FROM ready
  WHERE label = 1 GROUP BY cwe_id ORDER BY cnt DESC, value ASC LIMIT 6""")
def top_cwe_ready(spark, sf):
    """A4 (prep report): top 6 CWE ids of the ready table, 'Unknown' included."""
    ready = PP.ready(functions_raw(spark, sf))
    return A.top_values(ready.filter(F.col("label") == 1), "cwe_id", 6)


@register("top_projects", FX + """SELECT project, count(*) AS total,
       CAST(sum(CASE WHEN vul = 1 THEN 1 ELSE 0 END) AS BIGINT) AS vuln FROM functions_raw
  WHERE project IS NOT NULL GROUP BY project ORDER BY total DESC, project ASC LIMIT 8""")
def top_projects(spark, sf):
    """A5: top 8 projects with totals and vulnerable counts."""
    return A.top_projects(functions_raw(spark, sf), 8, label="vul")


@register("text_stats", FX + """
SELECT 0 AS ord, 'func_before' AS column_name, count(func_before) AS non_null,
       CAST(floor(avg(length(func_before))) AS BIGINT) AS avg_len FROM functions_raw
UNION ALL SELECT 1, 'func_after', count(func_after), CAST(floor(avg(length(func_after))) AS BIGINT) FROM functions_raw
UNION ALL SELECT 2, 'patch', count(patch), CAST(floor(avg(length(patch))) AS BIGINT) FROM functions_raw""",
          ints=("ord", "non_null"))
def text_stats(spark, sf):
    """Non-null count and truncated mean length per text column."""
    return A.text_stats(functions_raw(spark, sf), ["func_before", "func_after", "patch"])


def _audit_sql() -> str:
    present = {c for c, _ in RAW_TYPES}
    parts = []
    for i, (y, s) in enumerate(A.SCHEMA_MAPPING):
        found = s in present
        nn = f'count("{s}")' if found else "NULL"
        parts.append(f"SELECT {i} AS ord, '{y}' AS engine_column, '{s}' AS source_column, "
                     f"'{'FOUND' if found else 'missing'}' AS status, CAST({nn} AS BIGINT) AS non_null"
                     + (" FROM functions_raw" if found else ""))
    return FX + "\nUNION ALL\n".join(parts)


@register("schema_audit", _audit_sql(), ints=("ord",))
def schema_audit(spark, sf):
    """Expected -> source column mapping, FOUND / missing, non-null counts."""
    return A.schema_audit(functions_raw(spark, sf))


def _preview_sql(x: str) -> str:
    ls = O.lines(f"substring({x}, 1, 400)")
    return f"array_to_string(list_slice({ls}, 1, 12), chr(10))"


@register("sample_row", FX + f"""SELECT row_id, commit_id, project, "CWE ID" AS cwe_id,
       {_preview_sql("coalesce(func_before, '')")} AS preview
  FROM functions_raw WHERE vul = 1 ORDER BY row_id LIMIT 1""")
def sample_row(spark, sf):
    """The first vulnerable row with a function preview."""
    return A.sample_row(functions_raw(spark, sf))


@register("scan_prefix", FX + f"""SELECT row_id, vul, project FROM functions_raw
  ORDER BY row_id LIMIT {PREFIX_ROWS}""")
def scan_prefix(spark, sf):
    """The first 5,000 rows in file order (the explorer's sample mode)."""
    return functions_raw(spark, sf).orderBy("row_id").limit(PREFIX_ROWS).select("row_id", "vul", "project")
