"""Sequential choices worked out in rounds over whole tables, so that no group has to lie in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.session import discard, materialise


def ranked(rows: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """Rows with their place (from 0) in an order over the whole table, as a written table; sorted by range, so no task sees all rows.

    Rows that tie in all of ``order`` get places in any order.
    """
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row for each partition
    before = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    out = materialise(placed.withColumn("_part", part).join(F.broadcast(before.drop("_n")), "_part").withColumn(rank, F.col("_before") + within).select(*rows.columns, rank), "ranks")
    discard(placed)
    return out


def first_independent(edges: DataFrame) -> DataFrame:
    """The nodes that a greedy choice in ascending order drops, of a graph (a, b) with a < b, as a written table (node).

    Greedy keeps a node unless a kept one before it is its neighbour. In each round the nodes without an undecided neighbour before
    them are kept, their neighbours go, and both leave the graph with their edges. As many rounds as the longest chain of
    choices that depend on each other; each is two joins and aggregates over the edges that are left.
    """
    left = materialise(edges.select("a", "b").distinct(), "edges")
    gone, spare = [], []
    while not left.isEmpty():
        free = left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        out = materialise(left.join(free, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct(), "dropped")
        gone.append(out)
        # edges of dropped nodes say nothing any more; kept nodes have no others than to these
        rest = left.join(out, F.col("a") == F.col("node"), "left_anti").join(out, F.col("b") == F.col("node"), "left_anti")
        spare.append(left)
        left = materialise(rest, "edges")
    nodes = gone[0] if gone else left.select(F.col("a").alias("node"))
    for x in gone[1:]:
        nodes = nodes.unionByName(x)
    done = materialise(nodes.distinct(), "nodes")
    discard(left, *gone, *spare)
    return done


def near_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b of sets (id, members) without empty ones: Jaccard similarity of ``least`` (above 0) or more.

    Two such sets share one of their rarest members: of a set of n, one of the n - ceil(least * n) + 1 rarest. Only sets that meet
    there, and whose sizes allow it, are compared.
    """
    terms = sets.select("id", F.explode(F.array_distinct("members")).alias("term"))
    common = terms.groupBy("term").agg(F.count("*").alias("df"))
    listed = terms.join(common, "term").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda s: s["term"]).alias("terms"))
    listed = materialise(listed.withColumn("n", F.size("terms")), "sets")
    rare = listed.select("id", "n", F.explode(F.slice("terms", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("term"))
    side = lambda k: rare.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), "term")
    met = side("a").join(side("b").hint("merge"), "term")  # several rows for each set of a table that may look small
    met = met.where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    held = lambda k: listed.select(F.col("id").alias(k), F.col("terms").alias(f"t{k}"))
    both = met.join(held("a"), "a").join(held("b"), "b")
    out = materialise(both.where(F.size(F.array_intersect("ta", "tb")) >= least * F.size(F.array_union("ta", "tb")) - 1e-9).select("a", "b"), "near")
    discard(listed)
    return out
