"""DuckDB SQL equivalents of the Spark queries (the correctness oracle).

Each builder returns an expression or a CTE list in DuckDB's dialect, written
from the same definitions as the Column functions in ``functions.text``.
Differences in dialect that matter:

* RE2 has no ``(?U)``; whitespace classes are spelled out.
* lambdas are ``lambda x: ...``; ``regexp_replace`` needs the ``'g'`` flag.
* doubles are rounded to 6 places and counts cast to BIGINT on both sides.
"""

from __future__ import annotations

from patchlens.functions import text as T

# Python's whitespace (str.isspace) spelled out for RE2.
WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, {lit(LINE_BREAK)})"
    return (f"(CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) "
            f"ELSE {parts} END)")


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, {lit(WS + '+$')}, '')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {lit('^' + WS + '+')}, ''), {lit(WS + '+$')}, '')"


def lines_added(x: str) -> str:
    return (f"CAST(len(list_filter({lines(x)}, lambda l: starts_with(l, '+') "
            f"AND NOT starts_with(l, '+++'))) AS BIGINT)")


def lines_removed(x: str) -> str:
    return (f"CAST(len(list_filter({lines(x)}, lambda l: starts_with(l, '-') "
            f"AND NOT starts_with(l, '---'))) AS BIGINT)")


def contains_any(x: str, terms) -> str:
    lc = f"lower({x})"
    return "(" + " OR ".join(f"contains({lc}, {lit(t)})" for t in terms) + ")"


def has_security_terms(x: str, terms=T.FUNCTION_SECURITY_TERMS) -> str:
    return f"CAST({contains_any(x, terms)} AS INTEGER)"


def _clean(x: str, file_headers: bool) -> str:
    cond = "(starts_with(l, '@@') AND contains(substring(l, 3), '@@'))"
    if file_headers:
        cond = f"({cond} OR starts_with(l, '+++') OR starts_with(l, '---'))"
    kept = f"list_transform(list_filter({lines(x)}, lambda l: NOT {cond}), lambda l: {rstrip('l')})"
    joined = f"array_to_string({kept}, chr(10))"
    return strip(f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def clean_diff(x: str) -> str:
    return _clean(x, False)


def clean_patch(x: str) -> str:
    return _clean(x, True)


def cyclomatic(x: str) -> str:
    pat = T.DECISION_PATTERN.replace(r"\s", WS)
    return f"CAST(len(regexp_extract_all(lower({x}), {lit(pat)})) + 1 AS BIGINT)"


def num_parameters(x: str) -> str:
    pat = T.SIGNATURE_PATTERN.replace(r"\s", WS)
    p = strip(f"regexp_extract(substring({x}, 1, {T.SIGNATURE_WINDOW}), {lit(pat)}, 1)")
    return (f"CAST(CASE WHEN {p} = '' OR {p} = 'void' THEN 0 "
            f"ELSE len(string_split({p}, ',')) END AS BIGINT)")


def num_function_calls(x: str) -> str:
    pat = T.CALL_PATTERN.replace(r"\s", WS)
    kws = ", ".join(lit(k) for k in T.NON_CALL_KEYWORDS)
    return (f"CAST(len(list_filter(regexp_extract_all({x}, {lit(pat)}, 1), "
            f"lambda t: NOT list_contains([{kws}], lower(t)))) AS BIGINT)")


def nesting_depth(x: str) -> str:
    braces = f"string_split(regexp_replace({x}, '[^{{}}]', '', 'g'), '')"
    step = ("CASE WHEN c = '{' THEN {'d': acc.d + 1, 'm': greatest(acc.m, acc.d + 1)} "
            "WHEN c = '}' THEN {'d': greatest(acc.d - 1, 0), 'm': acc.m} ELSE acc END")
    return (f"CAST(list_reduce({braces}, lambda acc, c: {step}, "
            f"{{'d': 0, 'm': 0}}).m AS BIGINT)")


def token_diversity(x: str) -> str:
    toks = f"regexp_extract_all({x}, {lit(T.IDENT_PATTERN)})"
    return (f"(CASE WHEN len({toks}) = 0 THEN 0.0 "
            f"ELSE len(list_distinct({toks})) / len({toks}) END)")


def keyword_count(x: str) -> str:
    lc = f"lower({x})"
    parts = [f"((length({lc}) - length(replace({lc}, {lit(t)}, ''))) // {len(t)})"
             for t in T.KEYWORD_COUNT_TERMS]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def comment_ratio(x: str) -> str:
    ls = lines(x)
    s = strip("l")
    cond = f"starts_with({s}, '//') OR starts_with({s}, '*') OR starts_with({s}, '/*')"
    return (f"(CASE WHEN len({ls}) = 0 THEN 0.0 "
            f"ELSE len(list_filter({ls}, lambda l: {cond})) / len({ls}) END)")


def md5_key(x: str, seed: int = 42) -> str:
    return f"md5(coalesce(CAST({x} AS VARCHAR), chr(0) || 'null') || ':{seed}')"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------------------
# Derived input views (CTE bodies)
# ---------------------------------------------------------------------------

LINE_SQL = """CASE l_partkey % 8
     WHEN 0 THEN concat('  if (p', CAST(l_linenumber AS VARCHAR), ' > ', CAST(l_suppkey AS VARCHAR), ' && buf) {')
     WHEN 1 THEN '  }'
     WHEN 2 THEN concat('  memcpy(buf, src, len', CAST(l_linenumber AS VARCHAR), ');')
     WHEN 3 THEN concat('  // part ', CAST(l_partkey % 100 AS VARCHAR))
     WHEN 4 THEN '  for (i = 0; i < n; i++) {'
     WHEN 5 THEN concat('  ptr->f', CAST(l_suppkey % 10 AS VARCHAR), ' = malloc(n) ? a : b;')
     WHEN 6 THEN ''
     ELSE '  return check_auth(tok);   ' END"""
SIGN_SQL = "CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END"
ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_returnflag"

FUNCTIONS_RAW = f"""
fx_items AS (
  SELECT l_orderkey,
         string_agg(line, chr(10) ORDER BY {ORDER_SQL}) AS body,
         string_agg(sign || line, chr(10) ORDER BY {ORDER_SQL}) AS dbody,
         count(*) AS n,
         sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS n_add,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_del
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
               {LINE_SQL} AS line, {SIGN_SQL} AS sign FROM lineitem) t
  GROUP BY l_orderkey),
fx_base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, c.c_nationkey,
         i.body, CASE WHEN o.o_orderkey % 53 = 0 THEN concat(repeat(concat(i.dbody, chr(10)), 39), i.dbody)
                      ELSE i.dbody END AS dbody, i.n, i.n_add, i.n_del,
         CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
              ELSE concat(CASE o.o_custkey % 4
                            WHEN 0 THEN concat('void fn(void) {{', chr(10))
                            WHEN 1 THEN concat('int fn(int a, char *b) {{', chr(10))
                            WHEN 2 THEN concat('static int run(struct ctx *c) {{', chr(10))
                            ELSE concat('Foo::bar(a, b, c)', chr(10), '{{', chr(10)) END,
                          i.body, chr(10), '}}') END AS func_before
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN fx_items i ON o.o_orderkey = i.l_orderkey),
functions_raw AS (
  SELECT o_orderkey AS row_id,
         md5(CAST(o_custkey AS VARCHAR)) AS commit_id,
         concat('proj', CAST(c_nationkey AS VARCHAR)) AS project,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'C' WHEN '2-HIGH' THEN 'C++'
              WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'Java' ELSE 'Python' END AS lang,
         CAST(n_add AS BIGINT) AS add_lines,
         CAST(n_del AS BIGINT) AS del_lines,
         concat('{{"sha": "', md5(CAST(o_orderkey AS VARCHAR)), '", "additions": ', CAST(n_add AS VARCHAR), '}}')
           AS files_changed,
         concat('--- a/f.c', chr(10), '+++ b/f.c', chr(10), '@@ -1,', CAST(n AS VARCHAR), ' +1,',
                CAST(n AS VARCHAR), ' @@ fn', chr(10), dbody) AS patch,
         func_before,
         CASE WHEN o_orderstatus = 'F' THEN replace(func_before, 'memcpy(', 'memcpy_s(') ELSE func_before END
           AS func_after,
         CASE WHEN o_orderstatus = 'F' THEN concat('CWE-', CAST(o_custkey % 7 AS VARCHAR)) END AS "CWE ID",
         CASE WHEN o_orderstatus = 'F' THEN concat('CVE-', CAST(1999 + o_custkey % 20 AS VARCHAR), '-',
                                                   CAST(o_orderkey AS VARCHAR)) END AS "CVE ID",
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 100 AS DOUBLE) / 10.0 END AS "Score",
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS vul
  FROM fx_base)"""

COMMIT_FILES = f"""
commit_files AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS commit_hash,
         CASE o_orderkey % 10 WHEN 0 THEN 'Merge branch x' WHEN 1 THEN 'Fix typo in README'
              WHEN 2 THEN NULL ELSE concat('Change ', o_orderpriority) END AS commit_message,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS INTEGER) AS pos,
         concat('f', CAST(l_partkey AS VARCHAR), '.c') AS filename,
         CASE WHEN l_partkey % 11 = 0 THEN NULL
              WHEN l_partkey % 211 = 0 THEN concat(repeat(concat({SIGN_SQL}, {LINE_SQL}, chr(10)), 999), {SIGN_SQL}, {LINE_SQL})
              ELSE concat({SIGN_SQL}, {LINE_SQL}) END AS diff
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

COMMIT_RAW = """
commit_raw AS (
  SELECT commit_hash, max(commit_message) AS commit_message,
         CAST(count(*) AS INTEGER) AS files_changed,
         coalesce(string_agg(CASE WHEN diff IS NOT NULL AND diff <> '' THEN diff || chr(10) END, ''
                             ORDER BY pos), '') AS diff
  FROM commit_files GROUP BY commit_hash)"""

SCORED_ROWS = """
scored_rows AS (
  SELECT d.doc_id AS row_id, CAST(l.toxic AS INTEGER) AS label,
         CAST(d.n_chars % 101 AS DOUBLE) / 100.0 AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TEXT_ROWS = """
text_rows AS (
  SELECT d.doc_id AS row_id, d.text, d.source AS project, CAST(l.toxic AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
