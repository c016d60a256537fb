"""Character n-grams counted by slices of documents: the same as by exploding them, without shuffling any n-gram by document."""
import random

import pytest
from pyspark.sql import functions as F

from patchlens.operators import metrics as M
from patchlens.operators import ml as ML
from patchlens.operators import sampling as W
from patchlens.operators import tfidf as TF

PARAMS = TF.TfidfParams("char_wb", (3, 5), 60, 3, 0.95)


def corpus(spark, n=200, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "a", "é", "ÉTÉ", "x y", "日本語", "null\u0000in", "zz", "\n", "tab\tbed", "toxic"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), i % 3 % 2) for i in range(n)]
    rows += [(n, None, 0), (n + 1, "", 1), (n + 2, " \n\t ", 0), (7, "again alpha", 1), (None, "gamma alpha", 0), (None, "beta", 1)]
    return spark.createDataFrame(rows, "row_id long, text string, label int").repartition(5)


def entries(df):
    return {(r["row_id"], r["term"], r["idx"]): round(r["weight"], 9) for r in df.collect()}


@pytest.mark.parametrize("chars, ids", [(1 << 21, 1 << 12), (300, 4)])
def test_weights_are_those_of_exploded_terms(spark, monkeypatch, chars, ids):
    monkeypatch.setattr(TF, "SLICE_CHARS", chars)
    monkeypatch.setattr(TF, "SLICE_IDS", ids)
    docs = corpus(spark)
    tc = TF.materialize(TF.term_counts(docs, PARAMS))
    want = TF.top_terms(TF.term_stats(tc), docs.count(), PARAMS)
    vocab, weights = TF.fit_transform(docs, PARAMS)
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, want.collect())) and vocab.count() == 60
    assert entries(weights) == entries(TF.transform(tc, want))


def test_all_terms_of_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(TF, "SLICE_CHARS", 500)
    docs = corpus(spark).withColumn("fold", F.pmod(F.coalesce("row_id", F.lit(0)), F.lit(3)).cast("int"))
    want = TF.term_counts(docs, PARAMS, keep=("fold",)).groupBy("term", "fold").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))
    got = TF.char_stats(docs, PARAMS, part="fold").groupBy("term", F.col("part").alias("fold")).agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_large_alphabet(spark):
    text = "".join(chr(0x4E00 + i * 7 % 20000) for i in range(20000))
    docs = spark.createDataFrame([(i, text[i * 3:] + " " + "".join(chr(0x10000 + i)) * 4) for i in range(4)], "row_id long, text string")
    counts = {r["term"]: (r["df"], r["cnt"]) for r in TF.char_stats(docs, PARAMS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")).collect()}
    want = {}
    for r in docs.collect():
        seen = {}
        for w in r["text"].lower().split():
            for k in (3, 4, 5):
                for i in range(len(w) + 3 - k):
                    g = f" {w} "[i:i + k]
                    seen[g] = seen.get(g, 0) + 1
        for g, n in seen.items():
            want[g] = (want.get(g, (0, 0))[0] + 1, want.get(g, (0, 0))[1] + n)
    assert counts == want


def test_texts_alone_are_shuffled(spark):
    docs = corpus(spark)
    vocab, weights = TF.fit_transform(docs, PARAMS)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "explode" not in plan and "Window" not in plan
    stats = TF.char_stats(docs, PARAMS)
    assert stats.count() < TF.term_counts(docs, PARAMS).count() / 5


def test_vectors_are_those_of_exploded_terms(spark):
    docs = corpus(spark)
    vocab = TF.fit_char_vocabulary(docs, PARAMS)
    long = TF.transform(TF.term_counts(docs, PARAMS), vocab)
    key = lambda r: (str(r["row_id"]), r["label"], r["features"].indices.tolist(), [round(x, 9) for x in r["features"].values])
    got = TF.char_vectors(docs, vocab, PARAMS)
    assert got.columns == ["row_id", "text", "label", "features"]
    want = TF.to_sparse(docs.select("row_id", "label"), long, PARAMS.max_features)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_char_cross_validation_equals_fold_by_fold_fitting(spark):
    docs = corpus(spark, 150).where("row_id is not null and text <> 'again alpha'")
    got = {r["fold"]: r["f1"] for r in ML.text_cross_validate(docs, PARAMS, 3).collect()}
    folded = TF.materialize(W.stratified_kfold(docs, 3))
    for f in range(3):
        vocab, model = ML.fit_text_model(folded.where(F.col("fold") != f), PARAMS)
        scored = ML.score_text(folded.where(F.col("fold") == f), vocab, model, PARAMS)
        assert got[f] == pytest.approx(M.grouped_metrics(scored, (), 0.5, "prob", pred=F.col("pred") == 1).first()["f1"], abs=1e-6)


def test_folds_vectors_need_no_shuffle(spark):
    docs = corpus(spark, 60).where("row_id is not null").withColumn("fold", F.pmod("row_id", F.lit(3)).cast("int"))
    vocab = TF.fit_char_vocabulary(docs, PARAMS)
    terms = sorted(r["term"] for r in vocab.collect())
    counted = TF.materialize(TF.char_counts(TF.char_docs(docs, part="fold", keep=("label",)), terms, PARAMS))
    assert counted.count() == docs.select("row_id").distinct().count()
    for inside in (True, False):
        rows = TF.fold_vectors(counted, terms, vocab, PARAMS.max_features, 1, inside, ("label",))
        assert rows.count() == docs.where(F.col("fold") == 1 if inside else F.col("fold") != 1).count()
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
