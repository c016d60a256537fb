"""Text and code metrics as native Column expressions.

Every function takes a string Column and returns a Column; nothing here runs
Python per row.  The line and whitespace rules follow Python's string
methods, which the metric definitions are written against:

* ``py_lines``  = ``str.splitlines()``: breaks on CRLF and on
  ``\\n \\r \\v \\f \\x1c \\x1d \\x1e \\x85 \\u2028 \\u2029``; no trailing
  empty line; ``""`` has no lines.
* ``py_strip`` / ``py_rstrip`` = ``str.strip()`` / ``str.rstrip()``: remove
  all Unicode whitespace (Spark's ``trim`` only removes blanks).

Regexes that use ``\\s`` run with ``(?U)`` so that ``\\s`` is Unicode
whitespace as in Python; ``\\x1c-\\x1f`` are added by hand because Python
counts them as whitespace and Java does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the definitions the metrics were specified with).
# ---------------------------------------------------------------------------

# Sensitive terms searched in commit diffs (has_security_terms on commits).
COMMIT_SECURITY_TERMS = [
    "password", "passwd", "secret", "token", "auth",
    "sql", "query", "execute", "cursor",
    "eval(", "exec(", "subprocess", "shell=True",
    "os.system", "pickle", "deserializ",
    "xss", "csrf", "injection", "overflow",
    "strcpy", "gets(", "sprintf", "malloc",
    "chmod", "chown", "setuid",
    "base64", "encrypt", "decrypt", "hash(",
]

# Sensitive terms searched in function bodies (has_security_terms on functions).
FUNCTION_SECURITY_TERMS = [
    "password", "sql", "injection", "overflow", "exec(", "eval(",
    "strcpy", "gets(", "malloc", "free(", "memcpy", "sprintf",
    "auth", "token", "secret", "xss", "csrf", "buffer",
]

# Terms counted (with repeats) by security_keyword_count.
KEYWORD_COUNT_TERMS = [
    "strcpy", "strcat", "sprintf", "gets", "memcpy", "memset",
    "malloc", "free", "realloc", "alloca",
    "password", "passwd", "secret", "token", "auth", "key",
    "sql", "query", "exec", "eval", "system", "popen",
    "overflow", "injection", "xss", "csrf",
    "setuid", "chmod", "chown",
]

# Commit messages containing any of these (lower-cased) are noise.
NOISE_KEYWORDS = [
    "merge branch", "merge pull request",
    "whitespace", "formatting", "typo",
    "readme", "changelog", "licence", "license",
    "bump version", "update version",
    ".gitignore", "documentation", "docs only",
]

# Identifiers followed by "(" that are not counted as calls (case-folded).
NON_CALL_KEYWORDS = ["if", "for", "while", "switch", "return", "sizeof", "typeof"]

# Decision-point pattern of the cyclomatic complexity estimate.
DECISION_PATTERN = r"\b(if|else\s+if|for|while|case|catch)\b|\&\&|\|\||\?"
# First "( ... ) {" in the head of a function: its parameter list.
SIGNATURE_PATTERN = r"\(([^)]*)\)\s*\{"
# An identifier followed by "(".
CALL_PATTERN = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
# Identifier tokens.
IDENT_PATTERN = r"[a-zA-Z_][a-zA-Z0-9_]*"
SIGNATURE_WINDOW = 500

# ---------------------------------------------------------------------------
# Python string semantics
# ---------------------------------------------------------------------------

_BREAKS = r"\n\r\u000B\f\u001C\u001D\u001E\u0085\u2028\u2029"
LINE_BREAK_RE = rf"\r\n|[{_BREAKS}]"
# Whitespace that doesn't end a line.
_BLANK = r"[ \t\u001F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
_WS = r"[\s\x{1C}-\x{1F}]"
_LSTRIP_RE = r"(?U)\A" + _WS + "+"
_RSTRIP_RE = r"(?U)" + _WS + r"+\z"
_STRIP_RE = r"(?U)\A" + _WS + r"+|" + _WS + r"+\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def py_lines(col) -> Column:
    """``str.splitlines()`` as an array<string>."""
    return bound(F.split(_c(col), LINE_BREAK_RE, -1), lambda parts: F.when(
        F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def py_rstrip(col) -> Column:
    return F.regexp_replace(_c(col), _RSTRIP_RE, "")


def py_strip(col) -> Column:
    return F.regexp_replace(_c(col), _STRIP_RE, "")


def _starts(x: Column, prefix: str) -> Column:
    return x.startswith(prefix)


def _is_hunk_header(line: Column) -> Column:
    # starts with "@@" and has "@@" again from index 2 on
    return _starts(line, "@@") & (F.locate("@@", line, 3) > 0)


# ---------------------------------------------------------------------------
# T1 / T2  diff line counts
# ---------------------------------------------------------------------------

def _lines_with(col, sign: str) -> Column:
    """Lines starting with one or two of ``sign``: no character but a line break lies before it."""
    return F.regexp_count(_c(col), F.lit(rf"{sign}(?!{sign}{sign})(?<![^{_BREAKS}]{sign})"))


def lines_added(col) -> Column:
    """Lines starting with '+' but not '+++'."""
    return _lines_with(col, r"\+")


def lines_removed(col) -> Column:
    """Lines starting with '-' but not '---'."""
    return _lines_with(col, "-")


# ---------------------------------------------------------------------------
# T4  any sensitive term
# ---------------------------------------------------------------------------

def contains_any(col, terms) -> Column:
    lc = F.lower(_c(col))
    cond = F.lit(False)
    for t in terms:
        cond = cond | lc.contains(t)
    return cond


def has_security_terms(col, terms=FUNCTION_SECURITY_TERMS, enabled: bool = True) -> Column:
    """0/1: any term is a substring of the lower-cased text (P14 toggle)."""
    if not enabled:
        return F.lit(0)
    return contains_any(col, terms).cast("int")


def is_noise_message(col) -> Column:
    return contains_any(col, NOISE_KEYWORDS)


# ---------------------------------------------------------------------------
# T5 / T6  diff cleaning
# ---------------------------------------------------------------------------

def _clean_lines(col, drop_file_headers: bool) -> Column:
    def drop(line):
        d = _is_hunk_header(line)
        if drop_file_headers:
            d = d | _starts(line, "+++") | _starts(line, "---")
        return ~d
    joined = F.array_join(F.filter(py_lines(col), drop), "\n")
    # All lines right-stripped at once; after that nothing but line feeds can be left to strip at the end.
    joined = F.regexp_replace(joined, _BLANK + r"++(?=\n|\z)", "")
    return F.regexp_replace(F.rtrim(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit("\n")), _LSTRIP_RE, "")


def clean_diff(col) -> Column:
    """Drop hunk headers, right-strip lines, squeeze blank runs, strip."""
    return _clean_lines(col, drop_file_headers=False)


def clean_patch(col) -> Column:
    """clean_diff that also drops every line starting '+++' or '---'."""
    return _clean_lines(col, drop_file_headers=True)


# ---------------------------------------------------------------------------
# T7 - T13  code metrics
# ---------------------------------------------------------------------------

def cyclomatic_complexity(col) -> Column:
    # The first characters of all alternatives, which are cheaper to test than a word boundary.
    return (F.regexp_count(F.lower(_c(col)), F.lit(f"(?U)(?=[iefwc&|?])(?:{DECISION_PATTERN})")) + 1).cast("long")


def num_parameters(col) -> Column:
    head = F.substring(_c(col), 1, SIGNATURE_WINDOW)
    params = py_strip(F.regexp_extract(head, "(?U)" + SIGNATURE_PATTERN, 1))
    return F.when((params == "") | (params == "void"), F.lit(0)) \
            .otherwise(F.size(F.split(params, ",", -1))).cast("long")


def num_function_calls(col) -> Column:
    # Possessive: a shorter name is never followed by a bracket.
    names = F.regexp_extract_all(_c(col), F.lit("(?U)(?=[a-zA-Z_])" + CALL_PATTERN.replace("*", "*+")), 1)
    kw = F.array(*[F.lit(k) for k in NON_CALL_KEYWORDS])
    return F.size(F.filter(names, lambda x: ~F.array_contains(kw, F.lower(x)))).cast("long")


def nesting_depth(col) -> Column:
    braces = F.split(F.regexp_replace(_c(col), r"[^{}]+", ""), "")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc, ch):
        up = acc["d"] + 1
        return (F.when(ch == "{", F.struct(up.alias("d"), F.greatest(acc["m"], up).alias("m")))
                .when(ch == "}", F.struct(F.greatest(acc["d"] - 1, F.lit(0)).alias("d"), acc["m"].alias("m")))
                .otherwise(acc))
    return F.aggregate(braces, init, step, lambda acc: acc["m"]).cast("long")


def identifier_tokens(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(IDENT_PATTERN), 0)


def token_diversity(col) -> Column:
    return bound(identifier_tokens(col), lambda toks: F.when(F.size(toks) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_distinct(toks)) / F.size(toks)))


def count_occurrences(lc: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term (``str.count``)."""
    return ((F.octet_length(lc) - F.octet_length(F.replace(lc, F.lit(term), F.lit("")))) / F.lit(len(term.encode()))).cast("long")


def security_keyword_count(col) -> Column:
    lc = F.lower(_c(col))
    total = F.lit(0).cast("long")
    for t in KEYWORD_COUNT_TERMS:
        total = total + count_occurrences(lc, t)
    return total


def comment_ratio(col) -> Column:
    # What a stripped line starts with, without stripping it: counted in the whole text.
    comments = F.regexp_count(_c(col), F.lit(rf"(?:\A|[{_BREAKS}]){_BLANK}*+(?://|/?\*)"))
    return bound(F.size(py_lines(col)), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(comments / n))


# ---------------------------------------------------------------------------
# T14  previews
# ---------------------------------------------------------------------------

def diff_preview(col, n_chars: int = 1000) -> Column:
    return F.substring(_c(col), 1, n_chars)


def function_preview(col, n_chars: int = 400, n_lines: int = 12) -> Column:
    return F.array_join(F.slice(py_lines(F.substring(_c(col), 1, n_chars)), 1, n_lines), "\n")
