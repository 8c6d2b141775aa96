"""Connected components of a link table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.session import discard, materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), as a written table; root is the smallest node of its component.

    Each step takes minima (summed on the map side) and one join, whose hot keys Spark can split. The table is written to the
    shared folder after each round, so that a lost executor costs one round at most. Rounds grow with the logarithm of the
    longest chain. An empty table gives an empty result; links of a node to itself are ignored.
    """
    edges = materialise(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        done, edges = edges, materialise(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        discard(done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    found = materialise(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()), "roots")
    discard(edges)
    return found
