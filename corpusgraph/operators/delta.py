"""The delta sync: clusters that changed get a new profile, graph and cache follow, and all of it is one commit."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import state
from corpusgraph.session import discard, materialise
from corpusgraph.sources.store import Store

#: Tables of the sync: columns and key.
TABLES = {
    "profiles": ("cluster_id string, theme string, profile_hash string, updated_at timestamp", ["cluster_id"]),
    "edges": ("source string, target string, score double", ["source"]),
    "cache": ("cluster_id string, query string, result_json string", ["cluster_id"]),
    "sync_state": ("cluster_id string, last_sync timestamp, count_at_sync long, profile_hash string, sync_status string, last_error string, next_sync timestamp", ["cluster_id"]),
}
COUNTERS = ("total", "changed", "processed", "skipped", "profile_updates", "graph_updates", "cache_invalidations", "failed", "seconds")


def prepare(store: Store, parts: int = 64) -> None:
    for name, (schema, key) in TABLES.items():
        store.ensure(name, schema, key, parts)


def run(
    store: Store, snapshots: DataFrame, synthesize: Callable[[DataFrame, int], DataFrame], neighbours: Callable[[DataFrame], DataFrame], now: Column,
    retries: int = 2, backoff: float = 2.0, every: str = "INTERVAL 60 MINUTES", only: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic,
) -> dict[str, float]:
    """One run; the nine counters.

    ``snapshots``: (cluster_id, vector_count, last_modified). ``synthesize`` gives (cluster_id, theme, profile_hash, error) of clusters
    at an attempt; those with an error are tried again, ``retries`` times, after a pause that grows by ``backoff``. A cluster whose
    profile has the hash of its state is left as it is. Else its profile is stored, its edges, by ``neighbours`` of clusters,
    replace the old ones, and cached answers about it go. The state of each cluster that was tried notes the outcome; a
    failed one keeps its hash. A run that dies leaves everything as it was. ``only`` (cluster_id) narrows a run.
    """
    began = clock()
    change = store.begin()
    if only is not None:
        snapshots = snapshots.join(only.select("cluster_id").distinct(), "cluster_id", "left_semi")
    known = change.read("sync_state").select("cluster_id", "last_sync", "count_at_sync", F.col("profile_hash").alias("_hash"))
    changed = state.changed_clusters(snapshots, known.drop("_hash")).where("changed").select("cluster_id")
    todo = materialise(snapshots.join(changed, "cluster_id", "left_semi"), "changed")
    left, good, spare = todo, [], []
    for attempt in range(retries + 1):
        out = materialise(synthesize(left, attempt).select("cluster_id", "theme", "profile_hash", "error"), "profiles")
        spare.append(out)
        good.append(out.where("error is null"))
        bad = out.where("error is not null")
        if attempt == retries or bad.isEmpty():
            break
        left = left.join(bad, "cluster_id", "left_semi")
        sleep(backoff * (attempt + 1))
    done = good[0]
    for x in good[1:]:
        done = done.unionByName(x)
    done = materialise(done.join(known.select("cluster_id", "_hash"), "cluster_id", "left").withColumn("updated", ~F.col("profile_hash").eqNullSafe(F.col("_hash"))).drop("_hash"), "done")
    new = done.where("updated")
    change.upsert("profiles", new.select("cluster_id", "theme", "profile_hash", now.alias("updated_at")))
    edges = materialise(neighbours(new.select("cluster_id")), "edges")
    change.delete("edges", new.select(F.col("cluster_id").alias("source")))
    change.append("edges", edges)
    gone = change.read("cache").join(new.select("cluster_id"), "cluster_id", "left_semi").count()
    change.delete("cache", new.select("cluster_id"))
    succeeded = done.select("cluster_id", "profile_hash", F.when(F.col("updated"), "success").otherwise("skipped").alias("sync_status"), F.lit(None).cast("string").alias("last_error"))
    failed = bad.select("cluster_id", F.lit(None).cast("string").alias("profile_hash"), F.lit("failed").alias("sync_status"), F.col("error").alias("last_error"))
    states = succeeded.unionByName(failed).join(todo.select("cluster_id", F.col("vector_count").alias("count_at_sync")), "cluster_id")
    states = materialise(states.select("*", now.alias("last_sync"), (now + F.expr(every)).alias("next_sync")), "states")
    change.upsert("sync_state", states, update={"profile_hash": F.coalesce(F.col("new.profile_hash"), F.col("old.profile_hash"))})
    n = states.agg(F.count_if(F.col("sync_status") != "failed"), F.count_if(F.col("sync_status") == "success"), F.count_if(F.col("sync_status") == "failed")).first()
    counts = dict(zip(COUNTERS, (snapshots.count(), todo.count(), n[0], 0, n[1], n[1], gone, n[2]), strict=False))
    change.commit()
    discard(todo, done, edges, states, *spare)
    return counts | {"seconds": clock() - began}
