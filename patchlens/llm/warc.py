"""WARC fixity audit over Merkle trees.

Every record of a file is hashed; each run of ``FANOUT`` neighbours in offset order is a node
whose hash covers its children's offset ranges and hashes, and so on up to one root per file. Two
replicas are compared at their roots, and only the children of nodes that differ are
looked at on the next level, so sound files cost one comparison.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff

FANOUT = 16
CRLF = "\r\n"


def records(pages: DataFrame, file: str = "file", body: bool = True) -> DataFrame:
    """WARC/1.1 resource records of ``pages`` (``file``, page_id, url, html).

    file, ordinal (from 0 in page_id, url, html order), offset, length, record (binary); without ``body`` their SHA-256 (hash) in
    place of the records, so that a file's bodies are not shuffled to one task. A null url or html
    counts as empty, a null id is written as an empty one, a null file is a file like any other. Repeated
    rows are records of their own. An empty table has no records. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF), html, F.lit(CRLF + CRLF))
    # Bodies needn't be sorted: their hash orders rows that share id and url.
    made = pages.select(F.col(file).alias("file"), "page_id", "url", F.xxhash64("html").alias("tie"), text.cast("binary").alias("record"))
    sized = made.withColumn("length", F.octet_length("record").cast("long"))
    said = "record" if body else "hash"
    sized = sized if body else sized.withColumn("hash", F.sha2("record", 256)).drop("record")
    order = Window.partitionBy("file").orderBy("page_id", "url", "tie")
    return sized.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        "length", said)


def tree(recs: DataFrame, work: Handoff) -> list[DataFrame]:
    """Levels from records to roots: file, ordinal, offset, length, hash (hex). A file's last level has one node.

    ``recs``: ``records`` with or without their bodies. Level 0 holds one row per record; a node above has at most FANOUT children, which is what
    one task gathers. An empty table has one empty level.
    """
    own = F.col("hash") if "hash" in recs.columns else F.sha2("record", 256)
    level = work.write(recs.select("file", "ordinal", "offset", "length", own.alias("hash")), "leaves")
    levels = [level]
    while (level.agg(F.max("ordinal")).first()[0] or 0) > 0:
        child = F.struct("ordinal", F.concat_ws(":", "offset", "length", "hash").alias("entry"))
        level = work.write(level.groupBy("file", F.floor(F.col("ordinal") / FANOUT).cast("long").alias("parent")).agg(
            F.min("offset").alias("offset"), F.sum("length").alias("length"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["entry"]), "\n"), 256).alias("hash"))
            .withColumnRenamed("parent", "ordinal").select("file", "ordinal", "offset", "length", "hash"), "nodes")
        levels.append(level)
    return levels


def audit(one: list[DataFrame], other: list[DataFrame], work: Handoff) -> DataFrame:
    """Records that differ between two replicas' trees: file, ordinal, offset, length, status, hash_one, hash_other.

    status: "changed", "missing" (only in the first replica) or "extra" (only in the other). Replicas
    whose largest files differ in size may have trees of different height; both are read from the lower top down.
    """
    top = min(len(one), len(other)) - 1
    open_ = None
    for k in range(top, -1, -1):
        a, b = (t[k].select("file", "ordinal", F.struct("offset", "length", "hash").alias(s)) for t, s in ((one, "a"), (other, "b")))
        if open_ is not None:
            a, b = (t.join(open_, F.col("file").eqNullSafe(F.col("f")) & (F.floor(F.col("ordinal") / FANOUT) == F.col("o")), "left_semi")
                    for t in (a, b))
        a = a.withColumnsRenamed({"file": "fa", "ordinal": "oa"})
        both = a.join(b, F.col("fa").eqNullSafe(F.col("file")) & (F.col("oa") == F.col("ordinal")), "full_outer")
        bad = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(
            F.when(F.col("a").isNotNull(), F.col("fa")).otherwise(F.col("file")).alias("file"),
            F.coalesce("oa", "ordinal").alias("ordinal"), "a", "b")
        open_ = work.write(bad, "bad")
        if k:
            open_ = open_.select(F.col("file").alias("f"), F.col("ordinal").alias("o"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return open_.select(
        "file", "ordinal", F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.length", "b.length").alias("length"),
        status.alias("status"), F.col("a.hash").alias("hash_one"), F.col("b.hash").alias("hash_other"))
