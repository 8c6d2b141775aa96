"""Mini-batch k-means: seeds by k-means||, centres moved by batches at rates of their own, the best of several starts.

All rows move the centres: they are dealt into batches by a hash of the key, written once a start by batch, and passes over all batches
go on until one lowers the sum of squared distances by less than ``LESS`` of it. A batch has ``batch`` rows or more, as a pass has
``BATCHES`` of them at most: batches come one after another, so their number may not grow with the rows. Only who names ``steps`` gets
a part: so many batches of about ``batch`` rows a start, each row in one at most. All rows are read to draw the seeds, to compare
several starts, and to be assigned. Centres (at most ``k`` rows), the candidates for seeds (about ``2 k`` a round) and one row of sums
a task are what passes through the driver.

Edge cases: more centres than rows are capped; k below 1 is an error; null and empty vectors aren't clustered; vectors of different
lengths are an error; without rows there are no clusters. The same keys, vectors and seed give the same clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import vectors as V
from corpusgraph.session import discard, materialise

ROUNDS = 3
#: Batches of a pass over all rows and passes at most (the reference's ``max_iter``), and the share of the sum that a pass must save to be followed by another.
BATCHES, PASSES, LESS = 8, 100, 0.001


def chance(key: Column | str, *salt: int) -> Column:
    """A number from 0 to 1 that a key has for some salt."""
    return F.pmod(F.xxhash64(key, *map(F.lit, salt)), F.lit(1 << 40)) / float(1 << 40)


def _points(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if sizes.min() != sizes.max():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, in blocks of centres so that a batch stays small."""
    out = np.empty((len(x), len(centres)))
    for lo in range(0, len(centres), 64):
        out[:, lo : lo + 64] = ((x[:, None] - centres[None, lo : lo + 64]) ** 2).sum(2)
    return out


def points(vecs: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): the rows that are clustered."""
    return vecs.select(F.col(key).alias("key"), V.as_double(F.col(vector)).alias("v")).where(F.size("v") > 0)


def place(vector: Column, centres: np.ndarray) -> Column:
    """(cluster, distance2) of vectors, which are neither null nor empty: the nearest centre, ties to the first.

    Other columns stay where they are: only vectors go to the workers, and the same centres give the same places again.
    """

    def run(column: pa.Array) -> pa.Array:
        at, far = [np.zeros(0, np.int32)], [np.zeros(0)]
        for lo in range(0, len(column), 512):
            d = np.round(squares(_points(column.slice(lo, 512)), centres), 6)
            at.append(d.argmin(1).astype(np.int32))
            far.append(d[np.arange(len(d)), at[-1]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(far))], names=["cluster", "distance2"])

    return F.arrow_udf(run, "cluster int, distance2 double")(vector)


def _nearest(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(key, v, cluster, d2): ties go to the first centre."""
    return rows.withColumn("_at", place(F.col("v"), centres)).select("key", "v", F.col("_at.cluster").alias("cluster"), F.col("_at.distance2").alias("d2"))


def seeds(rows: DataFrame, k: int, seed: int, start: int) -> np.ndarray:
    """k centres by k-means||: in each round rows are drawn by their share of the squared distances, then the candidates, weighted
    by the rows nearest to them, are thinned to k, each next one where the weighted distance is largest."""
    first = rows.orderBy(chance("key", seed, start), "key").select("v").first()
    found = np.array([first[0]], float)
    for r in range(ROUNDS):
        near = _nearest(rows, found)
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = near.where(chance("key", seed, start, r) < F.lit(2.0 * k / total) * F.col("d2")).orderBy("key").select("v").collect()
        if drawn:
            found = np.unique(np.concatenate([found, np.array([d[0] for d in drawn], float)]), axis=0)
    weight = np.zeros(len(found))
    for r in _nearest(rows, found).groupBy("cluster").count().collect():
        weight[r["cluster"]] = r["count"]
    return thin(found, weight, k)


def thin(found: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the candidates: the heaviest, then always the one whose squared distance to those before it, times its weight, is largest."""
    chosen = [int(weight.argmax())]
    best = squares(found, found[chosen])[:, 0]
    while len(chosen) < min(k, len(found)):
        chosen.append(int((best * np.maximum(weight, 1)).argmax()))
        best = np.minimum(best, squares(found, found[chosen[-1:]])[:, 0])
    return found[chosen]


def move(centres: np.ndarray, seen: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their counts after a batch: each member moves its centre by one over the number of members so far."""
    seen = seen + counts
    rate = np.where(seen > 0, 1 / np.maximum(seen, 1), 0.0)[:, None]
    return centres + rate * (sums - counts[:, None] * centres), seen


def _batch(vectors: DataFrame, found: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres and their counts after a batch, and its sum of squared distances before it. A task adds up its rows; one row a task leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, cost = np.zeros_like(found), np.zeros(len(found)), 0.0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = _points(b.column(0).slice(lo, 512))
                d = np.round(squares(x, found), 6)
                at = d.argmin(1)
                sums += np.equal.outer(np.arange(len(found)), at).astype(float) @ x
                counts += np.bincount(at, minlength=len(found))
                cost += d.min(1).sum()
        if counts.any():
            yield pa.RecordBatch.from_pylist([{"sums": sums.ravel(), "counts": counts, "cost": cost}])

    sums, counts, cost = np.zeros_like(found), np.zeros(len(found)), 0.0
    for r in vectors.mapInArrow(run, "sums array<double>, counts array<double>, cost double").collect():
        sums, counts, cost = sums + np.reshape(r["sums"], sums.shape), counts + r["counts"], cost + r["cost"]
    return *move(found, seen, sums, counts), cost


def centres(rows: DataFrame, k: int, batch: int = 256, steps: int | None = None, starts: int = 3, seed: int = 42) -> np.ndarray | None:
    """The centres of the start with the smallest sum of squared distances, over ``points`` of a written table; None without rows."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    n = rows.count()
    if not n:
        return None
    best, whole = None, steps is None
    parts = max(1, min(n // batch, BATCHES) if whole else n // batch)
    for start in range(starts):
        found = seeds(rows, min(k, n), seed, start)
        seen = np.zeros(len(found))
        dealt = rows.withColumn("step", F.floor(chance("key", seed, start, -1) * parts).cast("int")).select("v", "step")
        drawn = materialise(dealt if whole else dealt.where(F.col("step") < steps), "batches", ["step"])
        last = np.inf
        for _ in range(PASSES if whole else 1):
            cost = 0.0
            for s in range(parts if whole else min(steps, parts)):
                found, seen, more = _batch(drawn.where(F.col("step") == s).select("v"), found, seen)
                cost += more
            if not cost < (1 - LESS) * last:
                break
            last = cost
        discard(drawn)
        cost = _nearest(rows, found).agg(F.sum("d2")).first()[0] if starts > 1 else 0.0
        if best is None or cost < best[0]:
            best = cost, found
    return best[1]


def kmeans(vecs: DataFrame, key: str, vector: str, k: int, batch: int = 256, steps: int | None = None, starts: int = 3, seed: int = 42) -> DataFrame:
    """(key, cluster, distance2) of the start with the smallest sum of squared distances."""
    rows = materialise(points(vecs, key, vector), "points")
    found = centres(rows, k, batch, steps, starts, seed)
    if found is None:
        return vecs.sparkSession.createDataFrame([], f"{key} {rows.schema['key'].dataType.simpleString()}, cluster int, distance2 double")
    return _nearest(rows, found).select(F.col("key").alias(key), "cluster", F.col("d2").alias("distance2"))
