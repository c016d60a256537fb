"""Quality rules as a bitmask ledger.

Each document is measured once and each rule judged once; the ledger keeps the
measurements and one failure bit per rule. A policy is a version and the rules that it enforces: a mask over
the stored bits. Changing the policy, or asking what a rule alone costs, is arithmetic on the ledger.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patchlens.llm.common import SPACE, bounded_batches, gram_hash, string_parts, word_hashes
from patchlens.llm.terms import coded, runs

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")
WINDOW = 5  # words

#: Rule -> its failure, as SQL over the measurements. A rule's bit is its place in this list: append only.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "shouting": "100 * n_upper_words > 50 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
#: Line repeats and word length stay advisory: lists, verse and unspaced scripts are clean text.
PRODUCTION = Policy("2", (*BASE.rules, "symbols", "shouting"))
STRICT = Policy("strict", tuple(RULES))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _between(flags: np.ndarray, start, stop) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[stop] - total[start]


def _repeated(group: np.ndarray, value: np.ndarray):
    """Order by (group, value), and for each place in it whether it equals the one before."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return order, same


def measure_part(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    words, rows, start, stop = word_hashes(buf, off)
    out = {"n_words": np.diff(rows)}
    solid = ~SPACE[buf]
    out["word_chars"] = _between(solid & ((buf & 0xC0) != 0x80), off[:-1], off[1:])
    out["n_symbols"] = _between(_SYMBOL[buf], off[:-1], off[1:])
    shout = (_between(_UPPER[buf], start, stop) > 0) & (_between(_LOWER[buf], start, stop) == 0)
    out["n_upper_words"] = _between(shout, rows[:-1], rows[1:])
    # Lines: between newlines and row ends.
    inside = buf != 10
    line_start, line_stop, line_rows = runs(inside, off)
    number, _ = coded(buf, inside, line_start, line_stop)  # equal lines have one number
    doc = np.repeat(np.arange(n), np.diff(line_rows))
    full = _between(solid, line_start, line_stop) > 0
    number, doc = number[full], doc[full]
    order, same = _repeated(doc, number)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[order][same], minlength=n)
    # Windows of words inside one document that are found again in it.
    grams = gram_hash(words, WINDOW)
    owner = np.repeat(np.arange(n), out["n_words"])
    at = np.flatnonzero(owner[:len(grams)] == owner[WINDOW - 1:WINDOW - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    order, same = _repeated(owner[at], grams[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = at[order[twice]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    out["n_repeat_words"] = _between(np.cumsum(cover)[:-1] > 0, rows[:-1], rows[1:])
    return out


def measured(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measurements of its whole texts as long columns, named with ``prefix``.

    A null text has no words: every measurement is zero. An empty line, or one of blanks, is no line.
    All columns pass through, so a name that is there already is an error; choose a prefix.
    """
    names = docs.columns
    extra = [prefix + m for m in MEASURES]
    if set(extra) & set(names):
        raise ValueError(f"columns {sorted(set(extra) & set(names))} are there already")
    bounded_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType(), False) for c in extra]])

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text))
            for first, buf, off in string_parts(texts):
                got = measure_part(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, len(off) - 1) for i in range(len(names))]
                    + [pa.array(got[m].astype(np.int64)) for m in MEASURES], [*names, *extra])

    return docs.mapInArrow(run, schema)


def ledger(docs: DataFrame, *, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failed``: bit i is set if rule i of RULES fails.

    One row per row of docs, repeated rows and null ids included; null and empty texts fail few_words; an empty table gives no rows.
    """
    rows = measured(docs.select(*keep, F.col(text).alias("__text")), text="__text").drop("__text")
    return rows.withColumn("failed", failure_bits())


def failure_bits(prefix: str = "") -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        for m in MEASURES if prefix else ():
            rule = rule.replace(m, prefix + m)
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def rejected(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablations(rows: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """rule, n_failed, n_only (documents that only this rule of the policy rejects), n_rejected, n_rows.

    One aggregate over the distinct bit patterns, of which there are at most 2 ** len(RULES).
    """
    patterns = rows.groupBy(F.col(failed).bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    bits = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    one = patterns.select("bits", "n", bits.alias("r"))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"), F.sum("n").alias("n_rows"))


def kept(docs: DataFrame, policy: Policy = PRODUCTION, *, text: str = "text") -> DataFrame:
    """The documents that the policy doesn't reject, columns as they were; null and empty texts have too few words, repeated rows share a verdict."""
    rows = measured(docs, text=text, prefix="__q_")
    return rows.withColumn("__q_failed", failure_bits("__q_")).where(~rejected(policy, "__q_failed")).select(*docs.columns)
