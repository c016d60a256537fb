"""Commit-path queries: ingest, assemble, drop waterfall, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.functions import text as T
from patchlens.operators import filters as P
from patchlens.operators import profile as A
from patchlens.plans import commits as C
from patchlens.sources.fixtures import commit_files

CR = O.with_(O.COMMIT_FILES, O.COMMIT_RAW)


def _raw(spark, sf):
    return A.assemble_commits(commit_files(spark, sf))


@register("ingest_commit_files", CR + "SELECT commit_hash, commit_message, files_changed, diff FROM commit_raw",
          ints=("files_changed",))
def ingest_commit_files(spark, sf):
    """(commit, file) rows -> one row per commit (commit_raw schema)."""
    return _raw(spark, sf)


@register("assemble_commit", O.with_(O.COMMIT_FILES) + """
SELECT commit_hash, CAST(count(*) AS BIGINT) AS files_changed,
       CAST(count(CASE WHEN diff IS NOT NULL AND diff <> '' THEN 1 END) AS BIGINT) AS files_with_diff,
       CAST(length(coalesce(string_agg(CASE WHEN diff <> '' THEN diff || chr(10) END, '' ORDER BY pos), ''))
            AS BIGINT) AS diff_length,
       md5(coalesce(string_agg(CASE WHEN diff <> '' THEN diff || chr(10) END, '' ORDER BY pos), '')) AS diff_md5
FROM commit_files GROUP BY commit_hash""")
def assemble_commit(spark, sf):
    """Files per commit and the file-ordered diff (length and md5)."""
    files = commit_files(spark, sf)
    nonempty = files.groupBy("commit_hash").agg(
        F.sum(F.when(F.col("diff").isNotNull() & (F.col("diff") != ""), 1).otherwise(0)).alias("files_with_diff"))
    raw = A.assemble_commits(files)
    return raw.join(nonempty, "commit_hash").select(
        "commit_hash", F.col("files_changed").cast("long").alias("files_changed"),
        F.col("files_with_diff").cast("long").alias("files_with_diff"),
        F.length("diff").cast("long").alias("diff_length"), F.md5("diff").alias("diff_md5"))


@register("nest_commit_files", O.with_(O.COMMIT_FILES) + """
SELECT commit_hash, CAST(count(*) AS BIGINT) AS n_files,
       string_agg(filename, ',' ORDER BY pos) AS filenames FROM commit_files GROUP BY commit_hash""")
def nest_commit_files(spark, sf):
    """S5 nested form: commits with an ordered array<struct<pos, filename, diff>>."""
    nested = A.nest_commit_files(commit_files(spark, sf))
    return nested.select("commit_hash", F.size("files").cast("long").alias("n_files"),
                         F.array_join(F.transform("files", lambda f: f["filename"]), ",").alias("filenames"))


PREPARED = CR.rstrip() + f""",
prepared AS (
  SELECT commit_hash, coalesce(commit_message, '') AS commit_message, 'unknown' AS author_name, '' AS author_date,
         files_changed, coalesce(diff, '') AS diff FROM commit_raw),
reasoned AS (
  SELECT *, CASE WHEN length({O.strip('diff')}) < 30 THEN 'empty/too-short diff'
                 WHEN length(diff) > 10000 THEN 'diff too large (>10k chars)'
                 WHEN {O.contains_any('commit_message', T.NOISE_KEYWORDS)} THEN 'noise commit message'
                 ELSE 'kept' END AS drop_reason
  FROM prepared),
commit_clean AS (
  SELECT commit_hash, commit_message, author_name, author_date, files_changed,
         {O.lines_added('diff')} AS lines_added, {O.lines_removed('diff')} AS lines_removed,
         CAST(length(diff) AS BIGINT) AS diff_length,
         {O.has_security_terms('diff', T.COMMIT_SECURITY_TERMS)} AS has_security_terms,
         0 AS label, {O.clean_diff('diff')} AS diff
  FROM reasoned WHERE drop_reason = 'kept')
"""


@register("ensure_columns", PREPARED + "SELECT commit_hash, author_name, author_date FROM prepared")
def ensure_columns(spark, sf):
    """Author placeholders added when the columns are missing."""
    return C.prepared(_raw(spark, sf)).select("commit_hash", "author_name", "author_date")


@register("reorder_columns", PREPARED + "SELECT * FROM commit_clean",
          ints=("files_changed", "lines_added", "lines_removed", "diff_length", "has_security_terms", "label"))
def reorder_columns(spark, sf):
    """P2 (and the whole commit cleaning plan): canonical commit_clean columns."""
    return C.clean_commits(_raw(spark, sf))


@register("filter_commit_length", PREPARED + f"""SELECT commit_hash FROM prepared
 WHERE length({O.strip('diff')}) >= 30 AND length(diff) <= 10000""")
def filter_commit_length(spark, sf):
    """P8 (commits): stripped length >= 30 and unstripped length <= 10,000."""
    df = C.prepared(_raw(spark, sf))
    return df.filter(~P.commit_too_short(F.col("diff")) & ~P.commit_too_long(F.col("diff"))).select("commit_hash")


@register("filter_noise_message", CR + f"""SELECT commit_hash FROM commit_raw
 WHERE NOT {O.contains_any("coalesce(commit_message, '')", T.NOISE_KEYWORDS)}""")
def filter_noise_message(spark, sf):
    """Drop commits whose lower-cased message holds a noise phrase."""
    return P.filter_noise_message(_raw(spark, sf)).select("commit_hash")


@register("drop_waterfall", PREPARED.rstrip() + """,
rules AS (SELECT * FROM (VALUES (1, 'empty/too-short diff'), (2, 'diff too large (>10k chars)'),
                                (3, 'noise commit message'), (4, 'kept')) v(ord, reason)),
counts AS (SELECT drop_reason AS reason, count(*) AS n FROM reasoned GROUP BY drop_reason)
SELECT r.ord, r.reason, coalesce(c.n, 0) AS n FROM rules r LEFT JOIN counts c ON r.reason = c.reason
UNION ALL SELECT 0, 'original', (SELECT count(*) FROM reasoned)""", ints=("ord", "n"))
def drop_waterfall(spark, sf):
    """Rows dropped per first failing rule (zeros shown), kept, original."""
    return P.drop_waterfall(C.prepared(_raw(spark, sf)))


@register("dataset_means", PREPARED + """SELECT avg(lines_added) AS avg_lines_added,
       avg(lines_removed) AS avg_lines_removed, avg(diff_length) AS avg_diff_length,
       CAST(sum(has_security_terms) AS BIGINT) AS security_hits, count(*) AS kept FROM commit_clean""",
          doubles=("avg_lines_added", "avg_lines_removed", "avg_diff_length"), ints=("security_hits", "kept"))
def dataset_means(spark, sf):
    """Means of added / removed lines and diff length, keyword hits."""
    return A.dataset_means(C.clean_commits(_raw(spark, sf)))
