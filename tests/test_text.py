"""Text metrics on edge strings, each with its value worked out by hand."""
import pytest
from pyspark.sql import functions as F

from patchlens.functions import text as T

CODE = "int f(int a, char *b) {\n  // c\n  * d\n  /* e */\n  if (a && b || c) { while(x) { y(); } }\n}"
DIFF = "+a\n-b\n+++ c\n--- d\n@@ x @@\n ctx  \n\n\n\nend"

CASES = {
    T.lines_added: [("", 0), ("\n", 0), ("+", 1), ("++", 1), ("+++ b/f", 0), (" +x", 0), ("+a\r\n+b\x0b+c +d", 4), (DIFF, 1)],
    T.lines_removed: [("", 0), ("-", 1), ("--x", 1), ("---x", 0), ("-a\r-b", 2), (DIFF, 1)],
    # Hunk headers go, ends of lines are stripped, three or more newlines become two.
    T.clean_diff: [("", ""), ("\n\n\n\n\n", ""), ("a\t", "a"), ("@@@", "@@@"), ("@@@@", ""), ("@@ -1 +1 @@ f", ""),
                   ("x @@ y @@", "x @@ y @@"), ("a\r\nb\r\n", "a\nb"), ("a ", "a"), ("+++ b/f", "+++ b/f"),
                   (DIFF, "+a\n-b\n+++ c\n--- d\n ctx\n\nend")],
    T.clean_patch: [("", ""), ("+++ b/f", ""), ("---x", ""), ("--x", "--x"), (DIFF, "+a\n-b\n ctx\n\nend")],
    # One, and one more for each decision: if, while, && and || in CODE.
    T.cyclomatic_complexity: [("", 1), ("if (x)", 2), ("IF (x)", 2), ("ifx elif", 1), ("else if (x)", 2), ("else\n  if (x)", 2),
                              ("elseif (y)", 1), ("a ? b : c", 2), ("a&&b||c", 3), ("case 1: case 2:", 3), (CODE, 5)],
    T.num_parameters: [("", 0), ("f() {", 0), ("f(void) {", 0), ("f( void ) {", 0), ("f(a) {", 1), ("f(int (*cb)(void), int x) {", 0),
                       ("f(a, b)", 0), ("f(a,b,) {", 3), ("x" * 501 + "g(a, b) {", 0), (CODE, 2)],
    # Names before "(", without control words and sizeof: f and y in CODE.
    T.num_function_calls: [("", 0), ("f()", 1), ("sizeof (x)", 0), ("IF (x)", 0), ("fgets(buf)", 1), ("a (b(c))", 2),
                           ("9x(1)", 0), (CODE, 2)],
    T.nesting_depth: [("", 0), ("}}{{", 2), ("{{}{}}", 2), ("}", 0), ("{}{}{", 1), (CODE, 3)],
    # Identifiers are ASCII: "caf" and "x" are two of them.
    T.token_diversity: [("", 0.0), ("1 2", 0.0), ("a a b", 2 / 3), ("a_1 A_1", 1.0), ("café x caf", 2 / 3)],
    T.security_keyword_count: [("", 0), ("fgets(buf)", 1), ("TOKEN token", 2), ("execute(sql)", 2), ("keykey", 2),
                               ("realloc alloca", 2), ("passwords", 1), (CODE, 0)],
    # "// c", "* d" and "/* e */" of six lines.
    T.comment_ratio: [("", 0.0), ("\n", 0.0), ("// a\nb", 0.5), (" * a", 1.0), ("a // b", 0.0), ("#\n/*", 0.5), (CODE, 0.5)],
    T.py_strip: [("", ""), (" a b ", "a b"), (" \x1fa　", "a"), ("\n\t", "")],
    T.py_rstrip: [(" a ", " a"), ("a \x1c", "a"), ("\t", "")],
}


@pytest.mark.parametrize("metric", list(CASES), ids=lambda f: f.__name__)
def test_by_hand(spark, metric):
    cases = CASES[metric]
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = [r[0] for r in frame.select(metric(F.col("s")).alias("v"), "i").orderBy("i").select("v").collect()]
    assert got == pytest.approx([v for _, v in cases]) if isinstance(cases[0][1], float) else got == [v for _, v in cases]


def test_lines(spark):
    cases = [("", []), ("\n", [""]), ("a\r\nb\r\n", ["a", "b"]), ("x\r\ry", ["x", "", "y"]),
             ("a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", list("abcdefghi"))]
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    assert [r[0] for r in frame.orderBy("i").select(T.py_lines(F.col("s"))).collect()] == [v for _, v in cases]


def test_has_security_terms(spark):
    cases = [("", 0), ("fgets(buf)", 1), ("gets", 0), ("os.SYSTEM", 1), ("author", 1), ("plain", 0)]
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = [r[0] for r in frame.orderBy("i").select(T.has_security_terms(F.col("s"), T.COMMIT_SECURITY_TERMS)).collect()]
    assert got == [v for _, v in cases]


def test_null_text_defaults(spark):
    df = spark.createDataFrame([(None,)], "s string")
    from patchlens.functions.enrich import metric_columns
    r = df.select(*metric_columns("s")).first()
    assert r["cyclomatic_complexity"] == 1 and r["num_parameters"] == 0 and r["comment_ratio"] == 0.0
