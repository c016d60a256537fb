"""Toxicity by two class-conditional Kneser-Ney language models.

Words are the terms of ``terms``. N_c(. w) is the number of different words that stand before w in class c, N_c(. .) their sum, and

    P_c(w) = max(N_c(. w) - D, 0) / N_c(. .) + sum of min(N_c(. v), D) over all v / N_c(. .) * S(w)

the Kneser-Ney continuation probability with the discount D. S, the backoff shared by both classes, is made of the numbers of
documents that have w, over the whole corpus: what a class has shown in D contexts or fewer is left to the corpus, alike
for both. Continuation counts don't rise with copies of a text, which pair counts do; scoring by pairs
P_c(w | h) caught fewer toxic texts (README), so the models are used at this order.

A text's evidence is the mean over its words of log P_toxic - log P_ordinary, each taken towards 0 by ``WEAK``: the many words
that say little then add nothing, whatever their number. A logistic curve makes it a score. Contexts
are counted on folds 2 to 4 of crc32(doc_id) mod 5, the curve is fitted on fold 1, fold 0 is held out.

The contexts come from a bounded sample of labelled rows (``sample_bytes`` of text a class, whole rows), so a model is of
bounded size and goes to the executors as arrays. S and the scores cover every document; nothing of a text is shuffled.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff, bounded_batches, string_parts
from patchlens.llm.terms import hashes, terms

#: Text bytes of labelled rows that each class's contexts are counted on, and that the curve is fitted on.
SAMPLE_BYTES = 8 << 20
FOLDS, HELD_OUT, CURVE = 5, 0, 1
DISCOUNT = 2.0
WEAK = 1.5
#: What stands before a text's first word.
START = np.uint64(0x5354415254)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _words(buf, off):
    """(code of every word, words before each row, hash of every distinct word)."""
    codes, rows, names = terms(buf, off)
    return codes, rows, hashes(names)


def labelled_sample(docs: DataFrame, labels: DataFrame, work: Handoff, sample_bytes: int) -> DataFrame:
    """(id, toxic, part) of the labelled rows that the models are fitted on: part 0 for contexts, 1 for the curve.

    Rows go by a hash of their id. Part 0 has as much text of either class, as much as the smaller one has and ``sample_bytes`` at most; of
    part 1 the same share of both is taken, so that the curve sees how frequent they are.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("id is not null and toxic in (0, 1)").distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), size.alias("size")).join(marks, "id").where(fold("id") != HELD_OUT) \
        .withColumn("part", (fold("id") == CURVE).cast("int"))
    rows = work.write(rows.groupBy("id", "toxic", "part").agg(F.sum("size").alias("size")), "labelled")
    total = {(r["part"], r["toxic"]): r["s"] for r in rows.groupBy("part", "toxic").agg(F.sum("size").alias("s")).collect()}
    room = min(sample_bytes, *(total.get((0, c), 0) for c in (0, 1)))
    share = {(0, c): room / total[0, c] for c in (0, 1) if (0, c) in total}
    share |= {(1, c): min(1.0, sample_bytes / max(total.get((1, k), 1) for k in (0, 1))) for c in (0, 1)}
    # A hash below a share of its range thins a class to about its room; the running sum then keeps exactly to it.
    keep, bound = F.lit(False), F.lit(sample_bytes)
    for (p, c), part in share.items():
        mine = (F.col("part") == p) & (F.col("toxic") == c)
        keep = keep | (mine & (F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63)) <= F.lit(part)))
        bound = F.when(mine & (F.col("part") == 0), F.lit(room)).otherwise(bound)
    by = Window.partitionBy("part", "toxic").orderBy("key", "id")
    thin = rows.withColumn("key", F.xxhash64("id")).where(keep).withColumn("upto", F.sum("size").over(by)).where(F.col("upto") <= bound)
    return work.write(thin.select("id", "toxic", "part"), "sample")


def context_counts(texts: DataFrame) -> DataFrame:
    """(toxic, word, n): different words that stand before each word in each class, over ``texts`` (toxic, text); words as hashes."""
    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            for first, buf, off in string_parts(batch.column("text")):
                codes, rows, names = _words(buf, off)
                if not len(codes):
                    continue
                before = np.concatenate([[-1], codes[:-1]])
                before[rows[:-1][np.diff(rows) > 0]] = -1
                size = len(names) + 1
                mine = np.repeat(toxic[first:first + len(off) - 1], np.diff(rows))
                keyed = np.unique((mine * size + before + 1) * size + codes)
                head = np.concatenate([[START], names])
                yield pa.RecordBatch.from_arrays([
                    pa.array((keyed // size // size).astype(np.int32)), pa.array(head[keyed // size % size].view(np.int64)),
                    pa.array(names[keyed % size].view(np.int64))], ["toxic", "before", "word"])

    pairs = texts.select("toxic", "text").mapInArrow(run, "toxic int, before long, word long").distinct()
    return pairs.groupBy("toxic", "word").agg(F.count("*").alias("n"))


def document_counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """Documents that have each word of ``known`` (sorted hashes), over all documents; at the end the (word, document) pairs of all other words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        table = shared.value
        total = np.zeros(len(table) + 1, np.int64)
        for batch in batches:
            for _, buf, off in string_parts(batch.column("text")):
                codes, rows, names = _words(buf, off)
                if not len(codes):
                    continue
                owner = np.repeat(np.arange(len(off) - 1), np.diff(rows))
                each = np.unique(owner * len(names) + codes) % len(names)
                total += np.bincount(_find(table, names)[each], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known) + 1, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted table, len(table) if it isn't there."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, len(table))


@dataclass
class Model:
    """``words``: sorted hashes; ``ratio``: log P_toxic - log P_ordinary of each, at the end of any other word; and the curve."""
    words: np.ndarray
    ratio: np.ndarray
    slope: float = 0.0
    intercept: float = 0.0

    def evidence(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text; 0 for a text without words."""
        codes, rows, names = _words(buf, off)
        ratio = self.ratio[_find(self.words, names)]
        strong = np.sign(ratio) * np.maximum(np.abs(ratio) - WEAK, 0)
        gain = np.concatenate([[0.0], np.cumsum(strong[codes])])
        return (gain[rows[1:]] - gain[rows[:-1]]) / np.maximum(np.diff(rows), 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -500, 500)))


def kneser_ney(contexts: pa.Table, documents) -> Model:
    """The model from (toxic, word, n); ``documents``: sorted hashes -> documents that have each, and of other words."""
    toxic, n = contexts.column("toxic").to_numpy(), contexts.column("n").to_numpy()
    word = contexts.column("word").to_numpy().view(np.uint64)
    words = np.unique(word)
    having = documents(words) + 1.0
    p = np.empty((2, len(words) + 1))
    for c in (0, 1):
        types = np.bincount(_find(words, word[toxic == c]), n[toxic == c], minlength=len(words) + 1)
        whole = types.sum()
        back = np.minimum(types, DISCOUNT).sum() / whole if whole else 1.0
        p[c] = np.maximum(types - DISCOUNT, 0) / max(whole, 1) + back * having / having.sum()
    # A class all of whose words are in more contexts than D leaves nothing to the backoff.
    p = np.maximum(p, 1e-300)
    return Model(words, np.log(p[1]) - np.log(p[0]))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of least loss, by Newton steps, the slope held a little towards 0.

    Two made-up rows, one of each class at evidence 0, keep it defined when a class is absent.
    """
    x = np.stack([np.ones(len(evidence) + 2), np.append(evidence, [0, 0])], 1)
    y = np.append(toxic, [0, 1]).astype(float)
    scale = max(float(np.std(x[:, 1])), 1e-9)
    x[:, 1] /= scale
    beta, pull = np.zeros(2), np.array([0.0, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-10:
            break
    return float(max(beta[1], 0.0) / scale), float(beta[0])


def fit(docs: DataFrame, labels: DataFrame, work: Handoff, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The models and the curve from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, work, sample_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sample, "id")
    model = kneser_ney(context_counts(texts.where("part = 0")).toArrow(), lambda known: document_counts(docs, known))

    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(first, len(off) - 1), pa.array(model.evidence(buf, off))], ["toxic", "z"])

    curve = texts.where("part = 1").select("toxic", "text").mapInArrow(run, "toxic int, z double").toArrow()
    model.slope, model.intercept = fit_curve(curve.column("z").to_numpy(), curve.column("toxic").to_numpy())
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text), whole texts."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text")):
                score = shared.value.score(shared.value.evidence(buf, off))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(off) - 1), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, work: Handoff, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) of every row of ``docs``.

    Labels of fold 0 (held_out) are never read. Labels that are null or not 0 or 1 are ignored; an id labelled both ways counts for both.
    Null and empty texts, and texts without words, have no evidence: their score is the curve's at 0. Equal texts have equal
    scores. A null id is no labelled row and not held out. If a class has no text to count contexts on, all evidence is 0 and
    every score is about the share of toxic rows that the curve has seen, one half without any. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = scored(docs, fit(docs, labels, work, sample_bytes))
    return rows.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
