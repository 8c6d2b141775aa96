"""An index of vectors for cosine similarity: inverted lists around pivots, with exact pruning by the triangle inequality.

Angles between vectors are a metric. Each vector lies in the list of its nearest pivot, at a known angle to it; a list knows the
largest such angle, its radius. A vector within an angle t of a query q can only lie in lists whose pivot is within radius + t of
q, and in such a list only where the angles of both to the pivot differ by t at most. So a search first asks the nearest list
of each query, which gives a bound on its k-th neighbour, and then only the lists that the bound leaves. Nothing is approximate:
results are those of a search of everything.

At scale: pivots are rows of a bounded sample (``sample`` rows at most, those with the smallest hash of the key), at most ``lists`` of
them; every vector is indexed. Lists are folders of a table, so lists that no query needs aren't read. A list is dealt into chunks of
``CHUNK`` rows by a hash, the queries that need it into blocks of ``CHUNK`` too, and a task compares one chunk with one block by a matrix
product; a list that holds a third of all rows is as many tasks as it has chunks. Only the k best of a chunk leave it.

Edge cases: null, empty and zero vectors have no direction: their similarity to all is 0, as they lie at a right angle to everything;
they are kept in a list of their own. Ties go to the smaller key; vectors of different lengths are an error; an index of no rows
finds nothing; repeated keys are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import vectors as V
from corpusgraph.operators import search
from corpusgraph.operators.ranking import top_per_group
from corpusgraph.session import discard, materialise

#: Rows of a list, and queries, that one task compares at once; most pivots, and rows that they are chosen from.
CHUNK, LISTS, SAMPLE = 4096, 1024, 8192
#: Angles are compared with this margin: cosines are rounded to six places, and small angles are known less exactly than those.
MARGIN, ROUNDED = 1e-6, 1e-6
#: The list of vectors without a direction.
NOWHERE = -1


@dataclass
class Index:
    """``rows`` (list, chunk, key, unit, angle) and ``lists`` (list, pivot, radius, n, chunks), both written tables."""

    rows: DataFrame
    lists: DataFrame
    pivots: np.ndarray

    def discard(self) -> None:
        discard(self.rows, self.lists)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length, zero where there is no direction."""
    size = {len(x) for x in column.to_pylist() if x}
    if len(size) > 1:
        raise ValueError("vectors differ in length")
    d = size.pop() if size else 1
    out = np.array([x if x else [0.0] * d for x in column.to_pylist()], float).reshape(-1, d)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm == 0, 1, norm)[:, None]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def pivots_of(rows: DataFrame, key: str, vector: str, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far from each other, from a bounded sample: each the row that lies farthest from those before it.

    About the square root of the number of rows are chosen, ``lists`` at most.
    """
    n = rows.count()
    drawn = rows.select(F.xxhash64(key).alias("h"), V.as_double(F.col(vector)).alias("v")).where(F.size("v") > 0).orderBy("h", "v").limit(sample).collect()
    x = _matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.float64()))) if drawn else np.zeros((0, 1))
    x = x[(x * x).sum(1) > 0]
    chosen, most = [], min(lists, max(1, math.isqrt(n)), len(x))
    best = np.full(len(x), -1.0)
    at = 0
    while len(chosen) < most:
        chosen.append(x[at])
        best = np.maximum(best, x @ x[at])
        at = int(best.argmin())
        if best[at] > 1 - 1e-9:
            break
    return np.array(chosen).reshape(-1, x.shape[1])


def _placed(rows: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(key, list, unit, angle): the nearest pivot of each vector and the angle to it."""
    source = rows.select(F.col(key).alias("key"), V.as_double(F.col(vector)).alias("v"))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            some = (x * x).sum(1) > 0
            if len(p) and some.any() and x.shape[1] != p.shape[1]:
                raise ValueError("vectors differ in length")
            cosines = x @ p.T if len(p) and some.any() else np.full((len(x), 1), -1.0)
            at = cosines.argmax(1)
            angle = np.where(some, _angles(cosines[np.arange(len(x)), at]), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(some, at, NOWHERE).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64())), pa.array(angle)], names=["key", "list", "unit", "angle"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, list int, unit array<double>, angle double")


def build(rows: DataFrame, key: str, vector: str, lists: int = LISTS, sample: int = SAMPLE, chunk: int = CHUNK) -> Index:
    """The index of all rows. Rows are written once by list; a large list is split over tasks and chunks by a hash of the key."""
    pivots = pivots_of(rows, key, vector, lists, sample)
    placed = materialise(_placed(rows, key, vector, pivots), "placed")
    known = placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    at = rows.sparkSession.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(pivots)] or [(NOWHERE, [])], "list int, pivot array<double>")
    known = materialise(known.join(at, "list", "left").select("list", "pivot", "radius", "n", "chunks"), "lists")
    dealt = placed.join(F.broadcast(known.select("list", "chunks")), "list").withColumn("chunk", F.pmod(F.xxhash64("key", "unit"), F.col("chunks").cast("long")).cast("int"))
    out = Index(materialise(dealt.select("list", "chunk", "key", "unit", "angle").hint("rebalance", "list"), "index", ["list"]), known, pivots)
    discard(placed)
    return out


def _asked(queries: DataFrame, index: Index, query: str, vector: str) -> DataFrame:
    """(query, unit, angles): the angle of each query to every pivot, as a written table."""
    source = queries.select(F.col(query).alias("query"), V.as_double(F.col(vector)).alias("v"))
    shared = queries.sparkSession.sparkContext.broadcast(index.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            some = (x * x).sum(1) > 0
            angles = _angles(x @ p.T) if len(p) and some.any() else np.zeros((len(x), len(p)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(angles), pa.list_(pa.float64()))], names=["query", "unit", "angles"])

    return materialise(source.mapInArrow(run, f"query {source.schema['query'].dataType.simpleString()}, unit array<double>, angles array<double>"), "asked")


def _needs(asked: DataFrame, index: Index, bound: Column) -> DataFrame:
    """(query, unit, bound, list, to, chunks): the lists that may hold a row within ``bound`` of each query; ``to`` is the angle to the pivot.

    Vectors without a direction lie at a right angle to everything, so their list counts from there on.
    """
    lists = F.broadcast(index.lists.agg(F.collect_list(F.struct("list", "radius", "chunks")).alias("known")))  # one row a list
    near = F.filter("known", lambda x: F.when(x["list"] == NOWHERE, F.col("bound") + MARGIN >= math.pi / 2).otherwise(F.element_at("angles", x["list"] + 1) - x["radius"] <= F.col("bound") + MARGIN))
    at = asked.withColumn("bound", bound).crossJoin(lists).select("query", "unit", "bound", "angles", F.explode(near).alias("x"))
    return at.select("query", "unit", "bound", F.col("x.list").alias("list"), F.when(F.col("x.list") == NOWHERE, F.col("bound")).otherwise(F.element_at("angles", F.col("x.list") + 1)).alias("to"), F.col("x.chunks").alias("chunks"))


def _compare(needs: DataFrame, index: Index, most: int | None, least: float | None, chunk: int = CHUNK) -> DataFrame:
    """(query, key, distance) of the pairs of needed lists: the ``most`` nearest of each chunk, or all with a similarity of ``least``."""
    kinds = needs.schema["query"].dataType.simpleString(), index.rows.schema["key"].dataType.simpleString()
    size = needs.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    size = materialise(size, "blocks")
    asked = needs.join(F.broadcast(size), "list").withColumn("block", F.pmod(F.xxhash64("query", "unit"), F.col("blocks").cast("long")).cast("int"))
    asked = asked.select("query", "unit", "bound", "to", "list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = index.rows.join(F.broadcast(size), "list").select("key", "unit", "angle", "list", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            x, keys, away = np.array(r["unit"].tolist(), float), r["key"].to_numpy(), r["angle"].to_numpy(float)
            order = np.argsort(away, kind="stable")
            x, keys, away = x[order], keys[order], away[order]
            apart = x.shape[1] > 0 and int(r["list"].iloc[0]) != NOWHERE
            for name, unit, bound, to in zip(q["query"], q["unit"], q["bound"], q["to"], strict=True):
                # rows whose angle to the pivot differs by more than the bound are out
                lo, hi = (np.searchsorted(away, to - bound - MARGIN, "left"), np.searchsorted(away, to + bound + MARGIN, "right")) if apart else (0, len(away))
                if lo >= hi:
                    continue
                unit = np.asarray(unit, float)
                if apart and unit.any() and len(unit) != x.shape[1]:
                    raise ValueError("vectors differ in length")
                far = np.round(1 - (x[lo:hi] @ unit if apart and unit.any() else np.zeros(hi - lo)), 6)
                if least is not None:
                    near = np.flatnonzero(far <= round(1 - least, 6))
                else:
                    near = np.arange(hi - lo)
                    if len(near) > most:
                        near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
                found += [(name, keys[lo + k], far[k]) for k in near]
        return pd.DataFrame(found, columns=["query", "key", "distance"])

    by = ["list", "chunk", "block"]
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(run, f"query {kinds[0]}, key {kinds[1]}, distance double")


def top_k(index: Index, queries: DataFrame, query: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """(query_id, rank, key, distance): the k nearest rows of each query; with ``itself`` a row of the query's own key counts as well."""
    most = k if itself else k + 1
    asked = _asked(queries, index, query, vector)
    has = F.size("angles") > 0
    # first the list of the nearest pivot alone, with no bound on the rows
    home = F.when(has & F.exists("unit", lambda x: x != 0), F.array_position("angles", F.array_min("angles")) - 1).otherwise(NOWHERE).cast("int")
    first = asked.select("query", "unit", F.lit(math.pi).alias("bound"), home.alias("list"), F.lit(0.0).alias("to")).join(F.broadcast(index.lists.select("list", "chunks")), "list")
    found = materialise(_best(_compare(first.select("query", "unit", "bound", "list", "to", "chunks"), index, most, None), most), "found")
    kth = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
    bound = F.when(F.coalesce("n", F.lit(0)) >= most, F.acos(F.greatest(F.lit(-1.0), F.lit(1 - ROUNDED) - F.col("last")))).otherwise(math.pi)
    bounded = asked.join(kth, "query", "left").withColumn("home", home)
    rest = _needs(bounded.select("query", "unit", "angles", bound.alias("bound")), index, F.col("bound"))
    rest = rest.join(asked.select("query", home.alias("list")), ["query", "list"], "left_anti").select(*rest.columns)
    both = found.unionByName(_best(_compare(rest, index, most, None), most))
    some = both if itself else both.where(~F.col("key").eqNullSafe(F.col("query")))
    return top_per_group(some, ["query"], [F.col("distance"), F.col("key")], k, ["key"]).select(F.col("query").alias("query_id"), "rank", "key", "distance")


def _best(found: DataFrame, most: int) -> DataFrame:
    """The nearest rows of each query: chunks give ``most`` and ties, so no query has many."""
    return top_per_group(found, ["query"], [F.col("distance"), F.col("key")], most, ["key"], rank="_n").drop("_n")


def within(index: Index, queries: DataFrame, query: str, vector: str, least: float) -> DataFrame:
    """(query_id, key, distance) of all rows whose similarity to a query is ``least`` or more."""
    asked = _asked(queries, index, query, vector)
    bound = math.acos(max(-1.0, least - ROUNDED))
    return _compare(_needs(asked, index, F.lit(bound)), index, None, least).select(F.col("query").alias("query_id"), "key", "distance")


def best_within(index: Index, queries: DataFrame, query: str, vector: str, least: float) -> DataFrame:
    """(query_id, key, distance): the nearest row of each query, if its similarity is ``least`` (above 0) or more; ties to the smaller key.

    Queries travel in blocks and rows stay in their lists, so nothing is dealt by list: a task meets the rows of a list with those queries
    of a block that the list may hold something for, and one row a query leaves it. Keys and query ids are whole numbers.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    turn, none = math.acos(max(-1.0, least - ROUNDED)), np.iinfo(np.int64).max
    radius = {r["list"]: r["radius"] for r in index.lists.select("list", "radius").collect()}  # one row a list
    pivots = queries.sparkSession.sparkContext.broadcast(index.pivots)
    asked = materialise(queries.select(F.col(query).cast("long").alias("code"), V.as_double(F.col(vector)).alias("v")), "asked")

    def run(q: dict, tiles: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        best, p = search.Best(q["v"], None, 1), pivots.value
        best.far[:], best.key[:] = round(1 - least, 6), none
        for t in tiles:
            lists, x, keys = t["list"].to_numpy(), search.units(t["unit"]), t["key"].to_numpy()
            for k in np.unique(lists[lists != NOWHERE]):
                here, x1 = lists == k, search.same_width(best.q, p.shape[1])
                some = np.flatnonzero(_angles(x1 @ p[k]) - radius[int(k)] <= turn + MARGIN)
                best.add(x[here], keys[here], some=some)
        r, near, far = best.found()
        r, near, far = r[near != none], near[near != none], far[near != none]
        for j in range(0, len(r), 1 << 16):
            at = slice(j, j + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q["code"][r[at]]), pa.array(near[at]), pa.array(far[at])], names=["query_id", "key", "distance"])

    found = search.by_products(index.rows.select("list", F.col("key").cast("long").alias("key"), "unit"), asked, run, "query_id long, key long, distance double", deal=False)
    return found.groupBy("query_id").agg(F.min(F.struct("distance", "key")).alias("x")).select("query_id", "x.key", "x.distance")


def read_share(index: Index, queries: DataFrame, query: str, vector: str, least: float) -> DataFrame:
    """One row: how many (query, row) pairs ``within`` looks at, of all of them."""
    needs = _needs(_asked(queries, index, query, vector), index, F.lit(math.acos(max(-1.0, least - ROUNDED))))
    rows = index.lists.select("list", "n")
    looked = needs.join(F.broadcast(rows), "list").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return looked.crossJoin(index.lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))).crossJoin(queries.agg(F.count("*").alias("queries")))


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float, lists: int = LISTS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of all rows whose cosine similarity is ``least`` (above 0) or more.

    Rows with equal vectors are a class, named by its smallest key: ``members`` (key, class) has every row once, and ``pairs`` (a, b,
    similarity) with a < b every pair of similar classes once, so copies aren't made into pairs. Vectors without a direction
    are classes of their own, without pairs.

    A class is at home in the list of its nearest pivot, and visits those lists in which one within the angle t of it could be at
    home: whose pivot is at most 2 t farther from it than its own. Homes of a chunk meet homes and visitors of the
    list, block by block; a pair that meets in both of its lists counts in the first.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    known = rows.select(F.col(key).alias("key"), V.as_double(F.col(vector)).alias("v")).withColumn("some", F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    known = materialise(known.withColumn("digest", F.when(F.col("some"), F.sha2(F.to_json(F.struct("v")), 256))), "vectors")
    first = materialise(known.where("some").groupBy("digest").agg(F.min("key").alias("class"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    repeated = first.where("n > 1").select("digest", "class")
    members = materialise(known.join(repeated, "digest", "left").select("key", F.coalesce("class", "key").alias("class")), "members")
    single = first.select("class", "v")
    pivots = pivots_of(single, "class", "v", lists)
    placed = _placed(single, "class", "v", pivots).where(F.col("list") != NOWHERE)
    shared, turn = rows.sparkSession.sparkContext.broadcast(pivots), math.acos(max(-1.0, least - ROUNDED))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x, home, angle = np.array(batch.column(2).to_pylist(), float), np.asarray(batch.column(1)), np.asarray(batch.column(3))
            if not len(x):
                continue
            r, c = np.nonzero(_angles(x @ p.T) <= (angle + 2 * turn + MARGIN)[:, None])
            away = _angles((x[r] * p[c]).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(c.astype(np.int32)), batch.column(2).take(pa.array(r)), pa.array(away), pa.array(home[r].astype(np.int32))], names=["key", "list", "unit", "angle", "home"])

    kind = rows.schema[key].dataType.simpleString()
    met = materialise(placed.mapInArrow(visits, f"key {kind}, list int, unit array<double>, angle double, home int"), "visits")
    radius = met.where("home = list").groupBy("list").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    size = materialise(radius.join(met.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks")), "list"), "sizes")
    deal = lambda of: F.pmod(F.xxhash64("key"), F.col(of).cast("long")).cast("int")
    near = met.join(F.broadcast(size), "list").where(F.col("angle") <= F.col("radius") + turn + MARGIN)
    left = near.where("home = list").select("key", "unit", "angle", "list", deal("chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = near.select(*[F.col(c).alias(c) for c in ("key", "unit", "angle", "home", "list")], deal("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            b = b.sort_values("angle", kind="stable")
            y, keys, away, home, here = np.array(b["unit"].tolist(), float), b["key"].to_numpy(), b["angle"].to_numpy(float), b["home"].to_numpy(), int(b["list"].iloc[0])
            for name, unit, angle in zip(a["key"], a["unit"], a["angle"], strict=True):
                lo, hi = np.searchsorted(away, angle - turn - MARGIN, "left"), np.searchsorted(away, angle + turn + MARGIN, "right")
                s = np.round(y[lo:hi] @ np.asarray(unit, float), 6)
                for k in np.flatnonzero(s >= round(least, 6)):
                    other, at = keys[lo + k], home[lo + k]
                    # both at home here: once, by key; else where the first of their lists is
                    if name < other if at == here else here < at:
                        found.append((name, other, s[k]))
        return pd.DataFrame(found, columns=["x", "y", "similarity"])

    by = ["list", "chunk", "block"]
    classes = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"x {kind}, y {kind}, similarity double")
    pairs = materialise(classes.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), "pairs")
    discard(known, first, met, size)
    return pairs, members


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, class, links): how many other rows are similar to each row, from ``similar_pairs``; rows of a class are similar to each other if it is in a pair or has several."""
    size = members.groupBy("class").agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("x")).select("x.*")
    near = both.join(size.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("near"))
    counts = size.join(near, "class", "left").select("class", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(counts, "class").select("key", "class", "links")
