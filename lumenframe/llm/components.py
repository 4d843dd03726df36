"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_table, join_hubs, stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) -> (node, root): root is the smallest node reachable.

    Nodes without an edge to another node are absent. Each round is two
    aggregations with map-side combine and two equi-joins in which a hub's rows
    are dealt over many tasks; the state is a table in the shared folder. Rounds
    grow with the logarithm of the component size. Null ends make no edge.
    """
    now = stage_table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage_table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        large = join_hubs(both, least.select("u", F.least("u", "m").alias("m"), "n"), "u", "n", "v").where("v > u")
        large = stage_table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = stage_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = (
            join_hubs(large, least2, "u", "n", "v")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = stage_table(small, "star")
        sign = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (now, least, large, least2):
            drop_table(old)
        now = new
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
