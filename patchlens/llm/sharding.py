"""Sharding by minimax contiguous partition, with DataFrame functions only.

Rows with equal text are one atomic group. Groups stand in the order of their key (the
text's SHA-256), so the order says nothing about the corpus. The smallest capacity with
which a greedy pass fills at most n shards is found by binary search, and the order is cut there.

The greedy pass never sees single groups. It runs over a histogram of key prefixes
that Spark aggregates; a prefix in which a cut may fall is split into longer prefixes,
which takes one more aggregate over just those prefixes. After about log(groups) / log(256)
rounds each cut falls between two groups, exactly. The histogram's size depends on the
number of shards, not on the data. A document finds its shard by comparing its key with
the cut keys: no join, no shuffle of texts.

A group larger than an even share can't be balanced; such groups (fewer than n) stand first
in the order, a shard each, and the others are cut evenly among the rest.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from patchlens.llm.common import Handoff

FIRST, MORE = 3, 2  # hex digits of the first prefixes, and by which they are lengthened
ROWS_PER_BUCKET = 50_000


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (the group), size (UTF-8 bytes plus 1), text_crc32; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


class _Leaves:
    """Ordered prefixes with their bytes and number of groups."""

    def __init__(self, rows: dict[str, tuple[int, int]]):
        self.name = sorted(rows)
        self.bytes = [rows[p][0] for p in self.name]
        self.groups = [rows[p][1] for p in self.name]
        self.start = [0, *accumulate(self.bytes)]  # bytes before each leaf
        self.total = self.start[-1]

    def low(self, x: int, least: int) -> int:
        """The furthest leaf border at or before x, but not before ``least``."""
        return max(least, self.start[bisect_right(self.start, x) - 1])

    def high(self, x: int) -> int:
        """The furthest place where a group may end at or before x."""
        if x >= self.total:
            return self.total
        i = bisect_right(self.start, x) - 1
        return x if self.groups[i] > 1 else self.start[i]

    def cuts(self, capacity: int, n: int, sure: bool) -> list[int]:
        """Where a greedy pass ends its n shards: at leaf borders (sure) or at the furthest possible places."""
        out, at = [], 0
        for _ in range(n):
            at = self.low(at + capacity, at) if sure else self.high(at + capacity)
            out.append(at)
        return out

    def search(self, n: int, sure: bool, least: int) -> int:
        """The smallest capacity from ``least`` on whose n shards reach the end."""
        lo, hi = least, max(least, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, n, sure)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def unsure(self, n: int, least: int) -> list[str]:
        """Prefixes of several groups in which a cut may fall for a capacity that may be the smallest."""
        some, all_ = self.search(n, False, least), self.search(n, True, least)
        early, late = self.cuts(some, n, True), self.cuts(all_, n, False)
        out = []
        for a, b in zip(early, late):
            for i in range(bisect_right(self.start, a) - 1, bisect_left(self.start, b + 1)):
                if i < len(self.name) and self.groups[i] > 1:
                    out.append(i)
        return [self.name[i] for i in sorted(set(out))]


def partition(groups: DataFrame, n: int) -> tuple[list[str], list[str]]:
    """(keys of groups with a shard of their own, first keys of the shards after the first of the rest).

    groups: key, bytes. Fewer groups than shards leave shards empty.
    """
    top = groups.orderBy(F.desc("bytes"), "key").limit(n).collect()
    rest = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for key, size in ((r["key"], r["bytes"]) for r in top):
        left = n - len(alone)
        if left > 1 and size * left > rest:
            alone.append(key)
            rest -= size
        else:
            break
    left = n - len(alone)
    others = groups.where(~F.col("key").isin(*alone)) if alone else groups
    least = max(-(-rest // left), max((r["bytes"] for r in top if r["key"] not in alone), default=0))
    rows: dict[str, tuple[int, int]] = {}

    def count(digits: int, inside: list[str] | None) -> None:
        part = others if inside is None else others.where(F.substring("key", 1, digits - MORE).isin(*inside))
        for r in part.groupBy(F.substring("key", 1, digits).alias("p")).agg(
                F.sum("bytes").alias("b"), F.count("*").alias("g")).collect():
            rows[r["p"]] = (r["b"], r["g"])

    count(FIRST, None)
    while True:
        leaves = _Leaves(rows)
        open_ = leaves.unsure(left, least)
        if not open_:
            break
        for size in sorted({len(p) for p in open_}):
            now = [p for p in open_ if len(p) == size]
            for p in now:
                del rows[p]
            count(size + MORE, now)
    capacity = leaves.search(left, True, least)
    ends = leaves.cuts(capacity, left, True)[:-1]
    # The border at byte position x is the first leaf that begins there; past the end nothing follows.
    return alone, [leaves.name[bisect_left(leaves.start, x)] if x < leaves.total else "~" for x in ends]


def shard(docs: DataFrame, work: Handoff, n: int = 16, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, key, size, text_crc32, shard (0 to n - 1), slot (gapless from 0 in its shard).

    Equal texts share a shard; null and empty texts are one group. Repeated rows get
    slots of their own. Null ids are rows like any other. An empty table gives no row. Other columns are not read.
    """
    rows = work.write(measured(docs, text, doc_id), "measured")
    groups = work.write(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    alone, cuts = partition(groups, n)
    work.drop(groups)
    place = F.lit(len(alone))
    for c in cuts:
        place = place + (F.col("key") >= c).cast("int")
    for i, key in enumerate(alone):
        place = F.when(F.col("key") == key, i).otherwise(place)
    # Slots: rank in a bucket of documents plus the rows in earlier buckets. Buckets are of one size
    # whatever the groups are, and identical rows are one row with a count until the end.
    same = rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("n")) \
        .withColumn("shard", place.cast("int"))
    total = rows.count()
    buckets = max(1, total // (n * ROWS_PER_BUCKET))
    same = same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    ranked = same.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    sizes = same.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket")
    offsets = sizes.withColumn("base", F.sum("rows").over(earlier) - F.col("rows")).drop("rows")
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "key", "size", "text_crc32", "shard",
        F.explode(F.sequence(F.col("base") + F.col("before"), F.col("base") + F.col("before") + F.col("n") - 1)).alias("slot"))
