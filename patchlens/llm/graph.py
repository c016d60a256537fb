"""Connected components over an edge table, entirely as joins and aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import Handoff


def connected_components(edges: DataFrame, work: Handoff, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Alternating star contraction: large-star hangs each node's larger neighbours on
    its smallest one, small-star does the same for the smaller ones. Every round
    is one min aggregate (combined before the shuffle) and one equi-join, so a hub
    with very many neighbours is split by the adaptive skew join. Rounds grow with
    the logarithm of the longest path. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = work.write(
        pairs.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(t):
        return t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(links)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large-star: all neighbours; keep the strictly larger ones
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = work.write(large, "large")
        # small-star: the smaller neighbours and the node itself hang on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = work.write(small, "links")
        now = state(small)
        work.drop(links, large)
        links = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
