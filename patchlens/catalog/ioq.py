"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.catalog.metricsq import SR
from patchlens.catalog.prep import ENRICHED_OUT, PREP_CTES, class_means_sql
from patchlens.functions.enrich import ENRICHED_FEATURES
from patchlens.operators import metrics as M
from patchlens.operators import profile as A
from patchlens.plans import preprocess as PP
from patchlens.sources import io as IO
from patchlens.sources import report as RP
from patchlens.session import scratch_path
from patchlens.sources.fixtures import functions_raw, scored_rows

CSV_COLS = ["row_id", "commit_id", "project", "lang", "patch", "func_before", "vul"]
FX = O.with_(O.FUNCTIONS_RAW)


@register("scan_csv", FX + "SELECT row_id, commit_id, project, lang, nullif(patch, '') AS patch, "
          "nullif(func_before, '') AS func_before, vul FROM functions_raw")
def scan_csv(spark, sf):
    """CSV with header and multi-line quoted fields, empty -> null (round trip)."""
    df = functions_raw(spark, sf).select(*CSV_COLS)
    return IO.csv_round_trip(df, "functions-csv")


@register("count_physical_lines", FX + """SELECT sum(1 + length(coalesce(patch, '')) - length(replace(coalesce(patch, ''), chr(10), ''))
    + length(coalesce(func_before, '')) - length(replace(coalesce(func_before, ''), chr(10), ''))) AS physical_rows,
  count(*) AS logical_rows FROM functions_raw""", ints=("physical_rows", "logical_rows"))
def count_physical_lines(spark, sf):
    """Physical lines minus header vs logical rows of a written CSV."""
    df = functions_raw(spark, sf).select(*CSV_COLS)
    path = scratch_path(spark, "lines-csv")
    IO.write_csv(df, path)
    return IO.count_lines(spark, path)


@register("sink_table", PREP_CTES + f"SELECT {', '.join(ENRICHED_OUT)} FROM enriched",
          doubles=("token_diversity", "comment_ratio"))
def sink_table(spark, sf):
    """The enriched table written as parquet to the shared folder and read back."""
    en = PP.enriched(functions_raw(spark, sf)).select(*ENRICHED_OUT)
    return IO.parquet_round_trip(en, "enriched")


@register("json_sink", SR + "SELECT threshold, f1 FROM best", doubles=("threshold", "f1"))
def json_sink(spark, sf):
    """The tuned threshold written as JSON and read back."""
    return IO.json_round_trip(M.best_threshold(scored_rows(spark, sf)), "threshold-json")


REPORT_SQL = PREP_CTES.rstrip() + f""",
means AS ({class_means_sql("enriched", ENRICHED_FEATURES)})
SELECT 'feature_means_vuln' AS section, ord, feature AS key, vuln_mean AS value FROM means
UNION ALL SELECT 'feature_means_safe', ord, feature, safe_mean FROM means
UNION ALL SELECT 'label_distribution', 0, CAST(label AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ready GROUP BY label
UNION ALL SELECT 'top_projects', 0, project, CAST(count(*) AS DOUBLE) FROM (
   SELECT project FROM ready WHERE project IS NOT NULL) p GROUP BY project
   QUALIFY row_number() OVER (ORDER BY count(*) DESC, project ASC) <= 6
"""


@register("report_sections", REPORT_SQL, ints=("ord",), doubles=("value",))
def report_sections(spark, sf):
    """The preprocessing / enrichment report as (section, ord, key, value)."""
    raw = functions_raw(spark, sf)
    ready = PP.ready(raw)
    means = PP.feature_means_by_class(PP.enriched(raw), ENRICHED_FEATURES)
    labels = ready.groupBy(F.col("label").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    top = A.top_projects(ready, 6)
    return RP.report([RP.Section("feature_means_vuln", means, "feature", "vuln_mean", ord="ord"),
                      RP.Section("feature_means_safe", means, "feature", "safe_mean", ord="ord"),
                      RP.Section("label_distribution", labels, "k", "v"),
                      RP.Section("top_projects", top, "project", "total")]).select("section", "ord", "key", "value")
