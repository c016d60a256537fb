"""Fits and the rows behind them: texts put together once, scored once, rows that are alike side by side; text metrics against Python's."""
import random
import re

from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators import metrics as M
from patchlens.operators import ml as ML


def test_a_functions_texts_are_put_together_once(spark):
    from patchlens.plans import preprocess as PP
    from patchlens.sources.fixtures import functions_raw
    rows = PP.collected_rows(functions_raw(spark, "/root/testdata/sf0.001")).select("row_id", "patch", "func_before")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 2


def test_scored_rows_are_read_once(spark):
    rows = [(1, 0.9, 1), (0, 0.9, 0), (1, 0.2, 0), (0, 0.4, 1), (0, None, 0), (1, 0.4, None)]
    df = spark.createDataFrame(rows, "label int, score double, pred int").where("label >= 0")
    out = M.grouped_metrics(df, pred=F.col("pred") == 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "Relation" in plan
    r = out.first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2)
    assert M.grouped_metrics(df, ["label"], pred=F.col("pred") == 1).count() == 2


def test_rows_of_a_fit_that_are_alike_are_neighbours(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(2000, numPartitions=3).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 101).alias("many"), (F.col("id") % 3).alias("few"))
    parts = ML.dealt(rows, cores * ML.DEALT_ROWS, ["many", "few"]).rdd.glom().collect()
    assert len(parts) == cores and max(map(len, parts)) < 2 * 2000 / cores
    for part in parts:
        order = [(r["few"], r["many"]) for r in part]
        assert order == sorted(order)
    assert ML.stored_for_fits(rows, ["many", "few"]) is rows
    monkeypatch.setattr(ML, "DEALT_ROWS", 100)
    assert sorted(ML.stored_for_fits(rows, ["many", "few"]).collect()) == sorted(rows.collect())


def test_the_split_has_the_features_of_its_query(spark):
    from patchlens.catalog import modelsq as MQ
    train, test = MQ._split(spark, "/root/testdata/sf0.001")
    assert train.columns == test.columns == ["row_id", "project", "label", *MQ.EXP_C, "split"]


def _clean(text: str, headers: bool) -> str:
    kept = [x.rstrip() for x in text.splitlines() if not (x.startswith("@@") and "@@" in x[2:] or headers and x.startswith(("+++", "---")))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def _depth(text: str) -> int:
    depth = most = 0
    for c in text:
        depth = depth + 1 if c == "{" else max(depth - 1, 0) if c == "}" else depth
        most = max(most, depth)
    return most


def _keywords(text: str) -> int:
    return sum(text.lower().count(t) for t in T.KEYWORD_COUNT_TERMS)


def _found(pattern: str, text: str) -> list:
    return re.findall(pattern.replace(r"\s", r"[^\S\x1c-\x1f]"), text)   # Java's \s


def _calls(text: str) -> int:
    return sum(x.lower() not in T.NON_CALL_KEYWORDS for x in _found(T.CALL_PATTERN, text))


def _comments(text: str) -> float:
    lines = text.splitlines()
    return sum(x.strip().startswith(("//", "*", "/*")) for x in lines) / len(lines) if lines else 0.0


def test_random_texts_against_python(spark):
    # Line breaks, blanks, marks and words; characters that Python and Java see alike.
    bits = ["\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", " ", "\t", "\x1f", "\xa0", "\u3000", "\u2003", "\U0001f600",
            "é", "+", "-", "@@", "/", "*", "//", "{", "}", "(", ")", "if", "else", "for", "case", "&&", "&", "||", "|", "?", "a", "_b1", "9", "alloca", "key",
            "token", "malloc"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)]
    metrics = {"added": (T.lines_added, lambda x: sum(y.startswith("+") and not y.startswith("+++") for y in x.splitlines())),
               "removed": (T.lines_removed, lambda x: sum(y.startswith("-") and not y.startswith("---") for y in x.splitlines())),
               "diff": (T.clean_diff, lambda x: _clean(x, False)), "patch": (T.clean_patch, lambda x: _clean(x, True)), "depth": (T.nesting_depth, _depth),
               "decisions": (T.cyclomatic_complexity, lambda x: len(_found(T.DECISION_PATTERN, x.lower())) + 1),
               "calls": (T.num_function_calls, _calls), "keywords": (T.security_keyword_count, _keywords), "comments": (T.comment_ratio, _comments)}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = df.select("i", *[f(F.col("t")).alias(name) for name, (f, _) in metrics.items()]).collect()
    for r in rows:
        assert r.asDict() == {"i": r["i"], **{name: g(texts[r["i"]]) for name, (_, g) in metrics.items()}}, texts[r["i"]]
    assert all(df.select(f(F.lit(None).cast("string"))).first()[0] is None for f, _ in (metrics["added"], metrics["patch"], metrics["comments"]))
