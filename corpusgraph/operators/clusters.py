"""Centroids, assignment, representatives and embedding metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import vectors as V
from corpusgraph.operators.ranking import top_per_group
from corpusgraph.operators.search import BLOCK, by_blocks, small_side
from corpusgraph.session import materialise


def centroid_dims(vecs: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean, size): means are combined before the shuffle, so a hot cluster is no hot task."""
    return vecs.select(group, F.posexplode(V.as_double(F.col(vector))).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("size"))


def centroids(vecs: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, size)."""
    dims = centroid_dims(vecs, group, vector)
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("centroid"), F.max("size").alias("size"))


def representatives(vecs: DataFrame, group: str, vector: str, key: str, k: int = 5, known: DataFrame | None = None) -> DataFrame:
    """The k members nearest to each centroid: (group, rank, key, distance). Centroids are broadcast where they are few by count.

    Stored centroids (group, centroid) in ``known`` are used where there are any; those of other groups are worked out.
    """
    if known is None:
        cents = centroids(vecs, group, vector).select(group, "centroid")
    else:
        cents = known.select(group, "centroid").unionByName(centroids(vecs.join(known.select(group), group, "left_anti"), group, vector).select(group, "centroid"))
    near = vecs.join(small_side(materialise(cents, "centroids")), group)  # worked out once, then counted
    near = near.select(group, key, F.round(1 - V.cosine(V.as_double(F.col(vector)), F.col("centroid")), 6).alias("distance"))
    return top_per_group(near, [group], [F.col("distance"), F.col(key)], k, [key])


def assign(vecs: DataFrame, cents: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, cluster, distance2): nearest centroid; ties to the smaller id. Centroids travel in blocks of one row each."""
    square = lambda c: F.aggregate(F.zip_with(V.as_double(F.col(vector)), c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    def nearest(block: DataFrame) -> DataFrame:
        one = block.agg(F.collect_list(F.struct("cluster", "centroid")).alias("cents"))
        return vecs.crossJoin(F.broadcast(one)).select(key, vector, F.array_min(F.transform("cents", lambda c: F.struct(F.round(square(c), 6).alias("distance2"), c["cluster"].alias("cluster")))).alias("best"))

    cents = cents if "_written_to" in cents.__dict__ else materialise(cents, "centroids")  # worked out once, then counted
    best = by_blocks(cents, "cluster", nearest)
    if cents.count() > BLOCK:
        best = best.groupBy(key).agg(F.min("best").alias("best"), F.first(vector).alias(vector))
    return best.select(key, vector, F.col("best.cluster").alias("cluster"), F.col("best.distance2").alias("distance2"))


def lloyd(vecs: DataFrame, key: str, vector: str, k: int, steps: int) -> DataFrame:
    """k-means from the first k vectors by key, a fixed number of steps: (key, cluster, distance2). k is capped by the rows.

    The centroids of each step are written and read again, so that plans don't nest.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    start = vecs.orderBy(key).limit(k).select(F.col(key).cast("long").alias("cluster"), V.as_double(F.col(vector)).alias("centroid"))
    for _ in range(steps - 1):
        start = materialise(centroids(assign(vecs, start, key, vector), "cluster", vector).select("cluster", "centroid"), "centroids")
    return assign(vecs, start, key, vector).drop(vector)


def kmeans(vecs: DataFrame, key: str, vector: str, k: int, seed: int = 42, steps: int = 20) -> DataFrame:
    """(key, cluster) by k-means from seeded starts; k is capped by the number of vectors, and less than 1 is an error. Rows without a vector are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 1:
        raise ValueError("k must be 1 or more")
    rows = vecs.where(F.col(vector).isNotNull()).select(key, array_to_vector(V.as_double(F.col(vector))).alias("features"))
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("cluster"))
    model = KMeans(k=min(k, n), seed=seed, maxIter=steps).fit(rows) if min(k, n) > 1 else None
    return model.transform(rows).select(key, F.col("prediction").alias("cluster")) if model else rows.select(key, F.lit(0).alias("cluster"))


def replace_centroids(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored centroids (cluster_id, size, ...) after a run: those of clusters (ids from 0 on) are replaced by the new ones with members."""
    return stored.where("cluster_id < 0").unionByName(new.where("cluster_id >= 0 and size > 0").select(*stored.columns))


def pairwise_cosine(vecs: DataFrame, vector: str) -> DataFrame:
    """(n, mean, deviation) of the cosines of all pairs, without pairs: from the sum and the Gram matrix of unit vectors.

    Zero and null vectors are left out. Partial sums of a task have the size of the Gram matrix, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, None, None
        for batch in batches:
            x = np.array([v for v in batch.column(0).to_pylist() if v], float)
            x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
            if len(x):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d + d * d)), pa.array(np.concatenate([[n], total, gram.ravel()]))], names=["cell", "x"])

    parts = vecs.select(V.as_double(F.col(vector)).alias("v")).mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    d = vecs.select(F.max(F.size(vector)).alias("d"))
    sums = parts.crossJoin(F.broadcast(d)).agg(
        F.sum(F.when(F.col("cell") < 0, F.col("x"))).alias("n"),
        F.sum(F.when((F.col("cell") >= 0) & (F.col("cell") < F.col("d")), F.col("x") * F.col("x"))).alias("s"),
        F.sum(F.when(F.col("cell") >= F.col("d"), F.col("x") * F.col("x"))).alias("g"),
    )
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s") - F.col("n")) / pairs
    return sums.select(F.col("n").cast("long").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt((F.col("g") - F.col("n")) / pairs - mean * mean), 6).alias("deviation"))
