"""The graph of clusters: parents by overlapping terms, neighbours by similarity, cycles broken at their weakest edge."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.components import components
from corpusgraph.operators.ranking import top_per_group
from corpusgraph.operators.search import small_side
from corpusgraph.session import discard, materialise


def generality(terms: DataFrame) -> DataFrame:
    """(cluster_id, terms, generality) of distinct (cluster_id, term): one less the mean share of clusters that hold a term."""
    df, n = terms.groupBy("term").agg(F.count("*").alias("df")), terms.agg(F.countDistinct("cluster_id").alias("n"))
    return terms.join(df, "term").crossJoin(F.broadcast(n)).groupBy("cluster_id").agg(F.count("*").alias("terms"), F.round(F.avg(1 - F.col("df") / F.col("n")), 6).alias("generality"))


def overlaps(terms: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap) with a < b: clusters whose sets of terms have a Jaccard similarity of ``least`` or more (0: that share a term).

    Two such sets share one of their rarest terms, a share of 1 - least of each set and one more, so only these are joined;
    a term that all clusters hold lists no pairs.
    """
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    sets = terms.join(df, "term").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda s: s["term"]).alias("terms"))
    size = F.size("terms")
    rare = sets.select("cluster_id", F.explode(F.slice("terms", F.lit(1), (size - F.ceil(size * least) + (1 if least > 0 else 0)).cast("int"))).alias("term"))
    side = lambda k: rare.select(F.col("cluster_id").alias(k), "term")
    pairs = side("a").join(side("b"), "term").where("a < b").select("a", "b").distinct()
    held = lambda k: sets.select(F.col("cluster_id").alias(k), F.col("terms").alias(f"t{k}"))
    both = pairs.join(held("a"), "a").join(held("b"), "b")
    score = F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 6)
    return both.select("a", "b", score.alias("overlap")).where(F.col("overlap") >= least)


def _both_ways(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def parents(overlap: DataFrame, similarity: DataFrame, general: DataFrame, min_terms: int = 3, min_similarity: float = 0.7, min_overlap: float = 0.4, gap: float = 0.1, most: int = 2) -> DataFrame:
    """(source, target, score, overlap, rank): up to ``most`` parents of each cluster, by overlap, similarity and id.

    overlap and similarity hold each pair once (a < b); pairs that similarity lacks count 0.
    """
    pairs = _both_ways(overlap.where(F.col("overlap") >= min_overlap), "overlap").join(_both_ways(similarity, "similarity"), ["a", "b"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    side = lambda k: small_side(general.select(F.col("cluster_id").alias(k), F.col("terms").alias(f"n{k}"), F.col("generality").alias(f"g{k}")))
    fit = pairs.where(F.col("similarity") >= min_similarity).join(side("a"), "a").join(side("b"), "b").where((F.col("nb") >= min_terms) & (F.round(F.col("gb") - F.col("ga"), 6) >= gap))
    best = top_per_group(fit, ["b"], [F.desc("overlap"), F.desc("similarity"), F.col("a")], most, ["a"])
    return best.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("similarity").alias("score"), "overlap", "rank")


def break_cycles(edges: DataFrame) -> DataFrame:
    """(source, target, kind) of edges (source, target, score, overlap): the weakest edge (score, overlap, ends) of each cycle becomes a NEIGHBOR.

    Cycles of different components don't meet. Where each node of a component points to one other, there is one ring, which is
    found by doubling links, however long it is. Other components are walked, each in one task: which cycle is next depends on
    the edges that went before.
    """
    known = edges.where("source is not null and target is not null").groupBy("source", "target").agg(F.max(F.struct("score", "overlap")).alias("w")).select("source", "target", "w.*")
    known = materialise(known, "edges")
    several = materialise(known.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source"), "several")
    if several.isEmpty():
        lost = _weakest_of_rings(known)
    else:
        roots = components(known.select(F.col("source").alias("a"), F.col("target").alias("b")))
        placed = materialise(known.join(roots.withColumnRenamed("node", "source"), "source", "left").withColumn("root", F.coalesce("root", "source")), "placed")
        hard = materialise(placed.join(several, "source", "left_semi").select("root").distinct(), "hard")
        kind = edges.schema["source"].dataType.simpleString()

        def walk(part: pd.DataFrame) -> pd.DataFrame:
            found = _walked({(s, t): w for s, t, *w in zip(*(part[c].tolist() for c in ("source", "target", "score", "overlap")), strict=True)})
            return pd.DataFrame(found, columns=["source", "target"])

        walked = placed.join(hard, "root", "left_semi").groupBy("root").applyInPandas(walk, f"source {kind}, target {kind}")
        lost = materialise(_weakest_of_rings(placed.join(hard, "root", "left_anti").select(*known.columns)).unionByName(walked), "lost")
        discard(roots, placed, hard)
    discard(known, several)
    return edges.join(lost.withColumn("_lost", F.lit(True)), ["source", "target"], "left").select("source", "target", F.when(F.col("_lost"), "NEIGHBOR").otherwise("PARENT_OF").alias("kind"))


def _weakest_of_rings(edges: DataFrame) -> DataFrame:
    """(source, target) of the weakest edge of each ring, as a written table; each source has one edge.

    Each node knows the node 1, 2, 4, ... steps ahead and the smallest on the way there. Once the steps are as many as the nodes that
    still have one ahead, what lies ahead are the nodes of rings, and the smallest of a round names the ring.
    """
    jump = materialise(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.least("source", "target").alias("low")), "jump")
    steps = 1
    while steps < jump.count():
        far = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b", F.least("x.low", "y.low").alias("low"))
        done, jump = jump, materialise(far, "jump")
        discard(done)
        steps *= 2
    rings = jump.join(jump.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("source"), "low")
    best = edges.join(rings, "source").groupBy("low").agg(F.min(F.struct("score", "overlap", "source", "target")).alias("x"))
    out = materialise(best.select("x.source", "x.target"), "lost")
    discard(jump)
    return out


def _walked(weight: dict) -> list[tuple]:
    """The edges that go, of one component: the weakest of the first cycle, until there is none. What lies on no cycle is taken off first."""
    after, before = defaultdict(set), defaultdict(set)
    for s, t in weight:
        after[s].add(t)
        before[t].add(s)
    ends = [k for k in {*after, *before} if not after[k] or not before[k]]
    while ends:
        k = ends.pop()
        for t in after.pop(k, ()):
            weight.pop((k, t), None)
            before[t].discard(k)
            if not before[t] and t in after:
                ends.append(t)
        for s in before.pop(k, ()):
            weight.pop((s, k), None)
            after[s].discard(k)
            if not after[s] and s in before:
                ends.append(s)
    lost = []
    while ring := _ring(weight):
        weakest = min(ring, key=lambda e: (*weight[e], e))
        lost.append(weakest)
        del weight[weakest]
    return lost


def _ring(edges: dict) -> list[tuple] | None:
    """The edges of one cycle: from the smallest node that lies on one, always by the smallest next node that does."""
    out: dict = {}
    for s, t in sorted(edges):
        out.setdefault(s, []).append(t)
    done: set = set()
    for root in sorted(out):
        path, at, todo = [root], {root: 0}, [iter(out[root])]
        while path and root not in done:
            t = next((t for t in todo[-1] if t not in done), None)
            if t is None:
                done.add(path[-1])
                del at[path.pop()]
                todo.pop()
            elif t in at:
                ring = [*path[at[t] :], t]
                return list(zip(ring, ring[1:], strict=False))
            else:
                at[t] = len(path)
                path.append(t)
                todo.append(iter(out.get(t, ())))
    return None


def neighbors(similarity: DataFrame, parent_edges: DataFrame, min_similarity: float = 0.7, most: int = 5) -> DataFrame:
    """(source, target, score), source < target: pairs that either end picked among its nearest clusters.

    Each cluster picks by similarity and id. Its parents and children (kind PARENT_OF) are no neighbours; demoted edges (kind
    NEIGHBOR) are, at both ends, and count among its picks.
    """
    near = _both_ways(similarity, "similarity").where(F.col("similarity") >= min_similarity)
    pair = lambda kind, s, t: parent_edges.where(F.col("kind") == kind).select(F.col(s).alias("a"), F.col(t).alias("b"))
    family = pair("PARENT_OF", "source", "target").unionByName(pair("PARENT_OF", "target", "source"))
    given = pair("NEIGHBOR", "source", "target").unionByName(pair("NEIGHBOR", "target", "source")).distinct()
    free = near.join(family, ["a", "b"], "left_anti").join(given, ["a", "b"], "left_anti")
    held = given.groupBy("a").agg(F.count("*").alias("held"))
    ranked = top_per_group(free, ["a"], [F.desc("similarity"), F.col("b")], most, ["b"]).join(held, "a", "left").where(F.col("rank") <= most - F.coalesce("held", F.lit(0)))
    chosen = ranked.select("a", "b", "similarity").unionByName(given.join(_both_ways(similarity, "similarity"), ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity")))
    return chosen.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.col("similarity").alias("score")).distinct()


def similarity_of(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked pairs (a, b) with their similarity, whichever end comes first; 0 where there is none."""
    known = pairs.select("a", "b", "similarity")
    return asked.withColumns({"_l": F.least("a", "b"), "_r": F.greatest("a", "b")}).join(known.withColumnsRenamed({"a": "_l", "b": "_r"}), ["_l", "_r"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def relations(edges: DataFrame) -> DataFrame:
    """(node, other, relation) of edges (source, target, kind): children, parents, and neighbours in both directions."""
    row = lambda df, a, b, r: df.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(r).alias("relation"))
    down, beside = edges.where("kind = 'PARENT_OF'"), edges.where("kind = 'NEIGHBOR'")
    return row(down, "source", "target", "child").unionByName(row(down, "target", "source", "parent")).unionByName(row(beside, "source", "target", "neighbor")).unionByName(row(beside, "target", "source", "neighbor")).distinct()


def export(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): nodes (id, label, score, tags) and edges (source, target, type, score) as they are handed to a viewer."""
    node = F.to_json(F.struct(F.col("cluster_id").alias("id"), F.col("theme_summary").alias("label"), F.col("confidence").alias("score"), "tags"))
    edge = F.to_json(F.struct("source", "target", F.col("kind").alias("type"), "score"))
    return profiles.select(F.lit("node").alias("kind"), node.alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), edge.alias("json")))


def bootstrap(profiles: DataFrame, wanted: DataFrame, source: str, made: DataFrame) -> DataFrame:
    """Profiles after a first run for a source: ``made`` joins them for the wanted clusters, but only where the source has none yet."""
    none = profiles.agg(F.count_if(F.col("source") == source).alias("n")).where("n = 0").drop("n")
    new = made.join(wanted.select("cluster_id").distinct(), "cluster_id", "left_semi").withColumn("source", F.lit(source)).crossJoin(F.broadcast(none))
    return profiles.unionByName(new.select(*profiles.columns))
