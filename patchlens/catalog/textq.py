"""Row-level text and code metric queries (T1-T14) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.functions import text as T
from patchlens.sources.fixtures import commit_files, functions_raw

FX = O.with_(O.FUNCTIONS_RAW)
CR = O.with_(O.COMMIT_FILES, O.COMMIT_RAW)


def _fx(spark, sf):
    return functions_raw(spark, sf)


def _commits(spark, sf):
    from patchlens.operators.profile import assemble_commits
    return assemble_commits(commit_files(spark, sf))


@register("lines_added", FX + f"SELECT row_id, {O.lines_added('patch')} AS lines_added FROM functions_raw")
def lines_added(spark, sf):
    """T1: '+' lines that are not '+++' lines, per patch."""
    return _fx(spark, sf).select("row_id", T.lines_added(F.col("patch")).cast("long").alias("lines_added"))


@register("lines_removed", FX + f"SELECT row_id, {O.lines_removed('patch')} AS lines_removed FROM functions_raw")
def lines_removed(spark, sf):
    """T2: '-' lines that are not '---' lines, per patch."""
    return _fx(spark, sf).select("row_id", T.lines_removed(F.col("patch")).cast("long").alias("lines_removed"))


@register("text_lengths", CR + f"""SELECT commit_hash, CAST(length(diff) AS BIGINT) AS diff_length_raw,
       CAST(length({O.clean_diff('diff')}) AS BIGINT) AS diff_length_clean FROM commit_raw""")
def text_lengths(spark, sf):
    """Code-point lengths of the commit diff before and after cleaning."""
    df = _commits(spark, sf)
    return df.select("commit_hash", F.length("diff").cast("long").alias("diff_length_raw"),
                     F.length(T.clean_diff(F.col("diff"))).cast("long").alias("diff_length_clean"))


@register("has_security_terms", CR + f"""SELECT commit_hash,
       {O.has_security_terms('diff', T.COMMIT_SECURITY_TERMS)} AS has_security_terms FROM commit_raw""")
def has_security_terms(spark, sf):
    """T4: any commit sensitive term in the lower-cased diff (0/1)."""
    df = _commits(spark, sf)
    return df.select("commit_hash",
                     T.has_security_terms(F.col("diff"), T.COMMIT_SECURITY_TERMS).alias("has_security_terms"))


@register("has_security_terms_functions", FX + f"""SELECT row_id,
       {O.has_security_terms('func_before')} AS has_security_terms FROM functions_raw
       WHERE func_before IS NOT NULL""")
def has_security_terms_functions(spark, sf):
    """T4 (functions): any function sensitive term in the lower-cased body."""
    df = _fx(spark, sf).filter(F.col("func_before").isNotNull())
    return df.select("row_id", T.has_security_terms(F.col("func_before")).alias("has_security_terms"))


@register("clean_diff", CR + f"SELECT commit_hash, {O.clean_diff('diff')} AS diff FROM commit_raw")
def clean_diff(spark, sf):
    """T5: hunk headers dropped, lines right-stripped, blank runs squeezed."""
    return _commits(spark, sf).select("commit_hash", T.clean_diff(F.col("diff")).alias("diff"))


@register("clean_patch", FX + f"SELECT row_id, {O.clean_patch('patch')} AS diff FROM functions_raw")
def clean_patch(spark, sf):
    """clean_diff that also drops '+++' / '---' lines."""
    return _fx(spark, sf).select("row_id", T.clean_patch(F.col("patch")).alias("diff"))


def _metric(name, sql_fn, col_fn):
    sql = FX + f"SELECT row_id, {sql_fn('func_before')} AS {name} FROM functions_raw WHERE func_before IS NOT NULL"

    def q(spark, sf):
        df = _fx(spark, sf).filter(F.col("func_before").isNotNull())
        return df.select("row_id", col_fn(F.col("func_before")).alias(name))
    return sql, q


for _name, _sql, _col, _doc in [
    ("cyclomatic_complexity", O.cyclomatic, T.cyclomatic_complexity, "T7: 1 + decision points"),
    ("num_parameters", O.num_parameters, T.num_parameters, "T8: parameters of the first signature"),
    ("num_function_calls", O.num_function_calls, T.num_function_calls, "T9: identifiers followed by '('"),
    ("nesting_depth", O.nesting_depth, T.nesting_depth, "T10: maximum brace depth"),
    ("token_diversity", O.token_diversity, T.token_diversity, "T11: distinct / total identifiers"),
    ("security_keyword_count", O.keyword_count, T.security_keyword_count, "T12: sensitive term occurrences"),
    ("comment_ratio", O.comment_ratio, T.comment_ratio, "T13: share of comment lines"),
]:
    _s, _q = _metric(_name, _sql, _col)
    _q.__doc__ = _doc
    register(_name, _s, doubles=(_name,) if _name in ("token_diversity", "comment_ratio") else ())(_q)


def _sql_preview(x: str) -> str:
    ls = O.lines(f"substring({x}, 1, 400)")
    return f"array_to_string(list_slice({ls}, 1, 12), chr(10))"


@register("preview_text", FX + f"""SELECT row_id, substring(patch, 1, 1000) AS diff_preview,
       {_sql_preview('func_before')} AS func_preview FROM functions_raw WHERE func_before IS NOT NULL""")
def preview_text(spark, sf):
    """First 1,000 chars of a diff; first 400 chars then 12 lines of a function."""
    df = _fx(spark, sf).filter(F.col("func_before").isNotNull())
    return df.select("row_id", T.diff_preview(F.col("patch")).alias("diff_preview"),
                     T.function_preview(F.col("func_before")).alias("func_preview"))
