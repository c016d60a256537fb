"""Source divergence audit over run-length columns.

The terms of a language are put in an order in which terms with equal counts stand together, and
cut into blocks. In a block each source's counts are a column of runs. A pair of sources is compared run by run: where the run
boundaries of both are intersected, all terms between two boundaries have the same two counts, so their share of the
divergence is one value times the run's length. Blocks are compared apart and their sums added up.

Counts are made in Arrow batches (each emits its own sums), then combined by Spark. p and f are integers:
1000000000 * (n + 2) exceeds a long at n of nine thousand million, so the quotient is made by long division in base 1000.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff, string_parts
from patchlens.llm.terms import terms

#: Terms of a block: a task holds a block's runs, at most terms x sources of them.
BLOCK = 1 << 14
LEAST_DOCS = 10
TOP = 10


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    def run(batches):
        for batch in batches:
            for first, buf, off in string_parts(batch.column("text")):
                n = len(off) - 1
                group = pa.StructArray.from_arrays([batch.column(c).slice(first, n) for c in ("lang", "source")], ["lang", "source"])
                keys, number = _numbered(group)
                codes, rows, names = terms(buf, off)
                owner = np.repeat(np.arange(n), np.diff(rows))
                size = max(1, len(names))
                # One entry per (document, term), then one per (group, term).
                per_doc, times = np.unique(owner * size + codes, return_counts=True)
                both = number[per_doc // size] * size + per_doc % size
                keyed, at = np.unique(both, return_inverse=True)
                total = np.bincount(at, times, minlength=len(keyed)).astype(np.int64)
                having = np.bincount(at, minlength=len(keyed)).astype(np.int64)
                which, said = pa.array(keyed // size), names.take(pa.array(keyed % size))
                yield pa.RecordBatch.from_arrays([
                    keys.field("lang").take(which), keys.field("source").take(which), said.cast(pa.large_string()).cast(pa.string()),
                    pa.array(total), pa.array(having)], ["lang", "source", "term", "n", "docs"])

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    parts = docs.select(*blank, F.col(text).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(group: pa.StructArray):
    """(distinct (lang, source), number of each row among them)."""
    lang, source = (group.field(i).dictionary_encode() for i in range(2))
    both = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
    _, first, number = np.unique(both, return_index=True, return_inverse=True)
    return group.take(pa.array(first)), number


def share(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(1000000000 * (n + 2) / whole), for whole below 9 * 10**15."""
    rest, out = n + 2, np.zeros(len(n), np.int64)
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def run_lengths(values: np.ndarray):
    """(ends, value) of each run of equal entries."""
    ends = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]])) + 1
    return ends, values[ends - 1]


def columns(kept: DataFrame) -> DataFrame:
    """(lang, block, source, ends, counts, width): the run-length column of every source in every block of its language.

    ``kept`` (lang, term, groups: array of (source, n) by source) is dealt out by ranges of (lang, groups): lexicographic
    order of the sparse count vectors, in which equal vectors are neighbours. A source without any of a block's terms has no row.
    """
    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            nonlocal held, size, block
            table = pa.Table.from_batches(held).combine_chunks()
            lang = table.column("lang").combine_chunks()
            lang = lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang
            groups = table.column("groups").combine_chunks()
            groups = groups.chunk(0) if isinstance(groups, pa.ChunkedArray) else groups
            held, size = [], 0
            code = lang.dictionary_encode().indices.to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            off = groups.offsets.to_numpy().astype(np.int64)
            flat = groups.values
            named = flat.field("source").dictionary_encode()
            name, n = named.indices.to_numpy().astype(np.int64), flat.field("n").to_numpy()
            row = np.repeat(np.arange(len(code)), np.diff(off))
            for a, b in zip(bounds[:-1], bounds[1:]):
                x, y = off[a], off[b]
                order = np.argsort(name[x:y], kind="stable") + x
                cut = np.concatenate([[0], np.flatnonzero(np.diff(name[order])) + 1, [len(order)]])
                out = [], [], []
                for i, j in zip(cut[:-1], cut[1:]):
                    column = np.zeros(b - a, np.int64)
                    column[row[order[i:j]] - a] = n[order[i:j]]
                    ends, values = run_lengths(column)
                    for o, v in zip(out, (named.dictionary[int(name[order[i]])].as_py(), ends, values)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang[int(a)].as_py()] * len(out[0]), pa.string()), pa.array([block] * len(out[0]), pa.int64()),
                    pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64())),
                    pa.array([int(b - a)] * len(out[0]), pa.int64())], ["lang", "block", "source", "ends", "counts", "width"])
                block += 1

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(i, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    yield from flush()
        if size:
            yield from flush()

    return kept.mapInArrow(run, "lang string, block long, source string, ends array<long>, counts array<long>, width long")


def _pair_sums(full: DataFrame) -> DataFrame:
    """(lang, one, other, value) of each block: both orders of every pair of sources. ``full`` has all sources of a block together."""
    def of_block(lang, sources):
        made = [(name, ends, share(values, whole)) for name, ends, values, whole in sources]
        left, right, value = [], [], []
        for i, (name, ends, p) in enumerate(made):
            for other, ends2, q in made[:i]:
                cut = np.union1d(ends, ends2)
                f = gap(p[np.searchsorted(ends, cut)], q[np.searchsorted(ends2, cut)])
                total = int((f * np.diff(cut, prepend=0)).sum())
                left += [name, other]
                right += [other, name]
                value += [total, total]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()),
                                           pa.array(value, pa.int64())], ["lang", "one", "other", "value"])

    def run(batches):
        at, sources = None, []
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("ends"), batch.column("counts"))]
            for i, (lang, block, name, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "source", "whole")))):
                if at != (lang, block):
                    if sources:
                        yield of_block(at[0], sources)
                    at, sources = (lang, block), []
                sources.append((name, *(v[o[i]:o[i + 1]] for o, v in lists), whole))
        if sources:
            yield of_block(at[0], sources)

    return full.mapInArrow(run, "lang string, one string, other string, value long")


#: p and f of the rows of ``_terms`` as SQL; div is exact on decimals and longs.
P = "1 + cast(1000000000 as decimal(20,0)) * cast({n} + 2 as decimal(18,0)) div cast({whole} as decimal(18,0))"
F_PQ = "(p - q) * (p - q) div (p + q)"


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, total, groups): terms in at least LEAST_DOCS documents of a language; groups: (source, n), one for each source that has it."""
    by_source = counts(docs, text, lang, source)
    one = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")
    return by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), one) \
        .where(F.col("docs") >= LEAST_DOCS).drop("docs")


def wholes(kept: DataFrame, docs: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, terms, whole, lang_whole) of every group that occurs: N + 2V of the group and of its language."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"))
    of_group = kept.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    rows = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0)
    return rows.select("lang", "source", "terms", (F.col("n_group") + 2 * F.col("terms")).alias("whole"),
                       (F.col("n_lang") + 2 * F.col("terms")).alias("lang_whole"))


def pairs(kept: DataFrame, totals: DataFrame, work: Handoff) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both orders."""
    parts = max(1, kept.count() // BLOCK)
    order = ["lang", "groups", "term"]
    runs = work.write(columns(kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("total")), "runs")
    blocks = runs.select("lang", "block", "width").distinct()
    full = blocks.join(totals.select("lang", "source", "whole"), "lang").join(runs.drop("width"), ["lang", "block", "source"], "left").select(
        "lang", "block", "source", "whole", F.coalesce("ends", F.array("width")).alias("ends"),
        F.coalesce("counts", F.array(F.lit(0).cast("long"))).alias("counts"))
    dealt = full.repartition("lang", "block").sortWithinPartitions("lang", "block")
    sums = _pair_sums(dealt).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    # A language without kept terms has no blocks; its sources differ by nothing.
    bare = totals.where("terms = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return sums.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value").unionByName(zero)


def leading_terms(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every kept term that a group has and uses more than its language does."""
    each = kept.select("lang", "term", "total", F.inline("groups")).join(totals, ["lang", "source"])
    pq = each.select("lang", "source", F.col("term").alias("item"), F.expr(P.format(n="n", whole="whole")).alias("p"),
                     F.expr(P.format(n="total", whole="lang_whole")).alias("q")).where("p > q")
    return pq.select("lang", "source", "item", F.expr(F_PQ).alias("value"))


def audit(docs: DataFrame, work: Handoff, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are apart, and by which terms.

    part "pair": item is each other source; part "term": item is each of the TOP terms that the source has more of than its language.
    Null texts, languages and sources count as empty strings. Repeated rows are documents of their own.
    A group without terms takes part with counts of zero; a language without kept terms gives pairs of value 0. Ties: the
    smaller item by UTF-8. An empty table gives an empty result. Other columns are not read.
    """
    kept = work.write(vocabulary(docs, text, lang, source), "kept")
    totals = work.write(wholes(kept, docs, lang, source), "totals")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    names = "lang", "source", "part", "item", "value"
    far = pairs(kept, totals, work).withColumn("part", F.lit("pair")).select(*names, rank)
    top = leading_terms(kept, totals).withColumn("part", F.lit("term")).select(*names, rank).where(F.col("rank") <= TOP)
    return far.unionByName(top)
