"""CSV with quoted line breaks, read by byte ranges.

Spark's multi-line reader takes a file as one task, because a line break may stand inside quotes. Here the
files are read as lines, which Spark splits into ranges wherever it likes, on any file system, and the
ranges are made to agree afterwards:

1. Each range counts its quotes. A range starts inside quotes if the number of quotes before it in its file is odd, so the
   parities of the ranges, a table of one row per range, fix all states. For both states that a range might
   start in, it also counts the records that start in it.
2. With its state known, a range puts its own lines together to records. What belongs to a record that began in an earlier
   range, or goes on in a later one, is a fragment, sent to the range in which the record began.
3. ``from_csv`` parses the records.

The table of ranges has as many rows as the scan has splits, which the driver has planned; the states go back to
the tasks as a broadcast. Quotes must be balanced (a quote inside a field is doubled, and the field quoted). A record ends at \\n or
\\r\\n outside quotes; blank lines outside quotes are no records. The first record of a file is its header.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, line) in file order inside a range; ``start`` is the range's first byte."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch):
    """((file, start), lines) for each run of one range in a batch."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    cut = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.column("line").slice(a, b - a)


def _odd_before(lines: pa.Array, odd: int):
    """For each line whether the quotes before it in its range are odd in number, and the same after the last; ``odd`` at the first."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    after = (np.cumsum(quotes) + odd) % 2
    return np.concatenate([[odd], after[:-1]]) == 1, int(after[-1])


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, value_set=pa.array(["", "\r"], lines.type)).to_numpy(zero_copy_only=False)


def ranges(spark: SparkSession, path) -> DataFrame:
    """One row per range that has a line start: lines (as \\n, \\r\\n and \\r end them), odd (quotes),
    and for the state outside (0) or inside (1) quotes at its start the records that start in it: starts0, starts1, any0, any1 (blank ones too)."""
    names = ["file", "start", "lines", "odd", "starts0", "starts1", "any0", "any1"]

    def run(batches):
        key, odd, total = None, 0, np.zeros(5, np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (*key, total[0], odd, *total[1:])], names)

        for batch in batches:
            for at, lines in _runs(batch):
                if at != key:
                    if key:
                        yield row()
                    key, odd, total = at, 0, np.zeros(5, np.int64)
                inside, odd = _odd_before(lines, odd)
                full = ~_blank(lines)
                returns = pc.sum(pc.count_substring(lines, "\r")).as_py() - pc.sum(pc.ends_with(lines, "\r")).as_py()
                total += [len(lines) + returns, (~inside & full).sum(), (inside & full).sum(), (~inside).sum(), inside.sum()]
        if key:
            yield row()

    return _lines(spark, path).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def states(found: DataFrame) -> DataFrame:
    """``ranges`` with the state each starts in (inside), the records that start in it (records, started with blank
    ones), whether the file's header is its first record, and the range that began the record it starts inside (owner)."""
    by = Window.partitionBy("file").orderBy("start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    known = found.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1) \
        .withColumn("records", F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0"))) \
        .withColumn("started", F.when(F.col("inside"), F.col("any1")).otherwise(F.col("any0")))
    begun = F.last(F.when(F.col("started") > 0, F.col("start")), ignorenulls=True).over(before)
    header = (F.col("records") > 0) & (F.coalesce(F.sum("records").over(before), F.lit(0)) == 0)
    return known.withColumn("owner", F.when(F.col("inside"), begun)).withColumn("header", header)


def _joined(lines: pa.Array, start: np.ndarray, stop: int) -> pa.Array:
    """The lines between neighbouring starts, the last until ``stop``, joined by line breaks."""
    off = pa.array(np.append(start, stop).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(off, lines.cast(pa.string())), "\n")


def _assembled(lines: DataFrame, known: dict, fragments: bool) -> DataFrame:
    """(file, owner, start, header, record): whole records (owner null), or the fragments of records that more than one range has."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(known)
    names = ["file", "owner", "start", "header", "record"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches):
        key = None

        def rows(texts, owner=None):
            """Whole records, or with an owner fragments; the first of a file that isn't blank is its header."""
            nonlocal header
            flags = np.zeros(len(texts), bool)
            if header and len(texts):
                full = np.flatnonzero(~_blank(texts))
                if len(full):
                    flags[full[0]] = True
                    header = False
            if (owner is not None) != fragments:
                return None
            n = len(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * n, kinds[0]), pa.array([owner] * n, kinds[1]), pa.array([key[1]] * n, kinds[2]), pa.array(flags),
                texts.cast(pa.string())], names)

        def ended():
            """The last lines of a range: a whole record, or the beginning or a part of a longer one."""
            if not parts:
                return None
            text = pa.array(["\n".join(parts)], pa.string())
            if not begun:
                return rows(text, owner)
            return rows(text, key[1] if odd else None)

        for batch in batches:
            for at, lines in _runs(batch):
                if at != key:
                    if key and (out := ended()):
                        yield out
                    key, parts = at, []
                    inside, owner, header = shared.value[at]
                    odd, begun = int(inside), not inside
                now, odd = _odd_before(lines, odd)
                start = np.flatnonzero(~now)
                if len(start):
                    parts += lines.slice(0, start[0]).to_pylist()
                    if parts and (out := rows(pa.array(["\n".join(parts)], pa.string()), None if begun else owner)):
                        yield out
                    if len(start) > 1 and (out := rows(_joined(lines, start[:-1], int(start[-1])))):
                        yield out
                    parts, begun = lines.slice(int(start[-1])).to_pylist(), True
                else:
                    parts += lines.to_pylist()
        if key and (out := ended()):
            yield out

    return lines.mapInArrow(run, "file long, owner long, start long, header boolean, record string")


def records(spark: SparkSession, path) -> DataFrame:
    """(record): the text of every record but the headers, without its line end."""
    table = states(ranges(spark, path)).select("file", "start", "inside", "owner", "header").collect()  # a row per split
    known = {(r["file"], r["start"]): (r["inside"], r["owner"], r["header"]) for r in table}
    lines = _lines(spark, path)
    out = _assembled(lines, known, False).where(~F.col("header")).select("record")
    if any(inside for inside, _, _ in known.values()):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"])
        cut = _assembled(lines, known, True).groupBy("file", "owner").agg(F.max("header").alias("header"), F.array_join(parts, "\n").alias("record"))
        out = out.unionByName(cut.where(~F.col("header")).select("record"))
    trimmed = F.when(F.col("record").endswith("\r"), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return out.select(trimmed.alias("record")).where("record <> ''")


def read(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The rows of CSV files with a header; empty fields are null."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = records(spark, path).select(F.from_csv("record", ddl, OPTIONS).alias("r")).select("r.*")
    return rows.select(*[F.when(F.col(f"`{f.name}`") == "", F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema.fields])


def count(spark: SparkSession, path) -> DataFrame:
    """(physical_rows, logical_rows): lines minus one header line for each file, and records, from one scan."""
    per_file = states(ranges(spark, path)).groupBy("file").agg(F.sum("lines").alias("lines"), F.sum("records").alias("records"))
    return per_file.agg((F.sum("lines") - F.count("*")).alias("physical_rows"), (F.sum("records") - F.count("*")).alias("logical_rows"))
