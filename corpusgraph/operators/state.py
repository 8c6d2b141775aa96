"""Mutable state on immutable tables: upserts, inserts if absent, replacement by source, expiry, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.ranking import first_per_key, latest_per_key


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: changes replace rows of their keys."""
    fresh = latest_per_key(changes, keys, order)
    return state.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def insert_absent(state: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First writer wins; rows whose key exists change nothing."""
    return state.unionByName(first_per_key(rows, keys, order).join(state.select(*keys), keys, "left_anti").select(*state.columns))


def replace_source(state: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """Rows of the sources that occur in ``rows`` are replaced."""
    return state.join(rows.select(source).distinct(), source, "left_anti").unionByName(rows)


def expire(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return df.where(F.col(at) >= cutoff)


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def changed_files(files: DataFrame, state: DataFrame, key: str, modified: str) -> DataFrame:
    """Files that are new or newer than their state."""
    known = state.select(key, F.col(modified).alias("_known"))
    return files.join(known, key, "left").where(F.col("_known").isNull() | (F.col("_known") < F.col(modified))).drop("_known")


def changed_clusters(snapshots: DataFrame, synced: DataFrame) -> DataFrame:
    """cluster_id and changed: no state, modified after the last sync, or (without a time) another count."""
    both = snapshots.join(synced, "cluster_id", "left")
    changed = (
        F.when(F.col("last_sync").isNull() & F.col("count_at_sync").isNull(), True)
        .when(F.col("last_modified").isNotNull() & F.col("last_sync").isNotNull() & (F.col("last_modified") > F.col("last_sync")), True)
        .when(F.col("last_modified").isNull() & (F.col("vector_count") != F.col("count_at_sync")), True).otherwise(False)
    )
    return both.select("cluster_id", changed.alias("changed"))


def tree_diff(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key and side: ``copy`` where only the source has it, ``delete`` where only the target has it."""
    copy = source.select(key).join(target.select(key), key, "left_anti").withColumn("side", F.lit("copy"))
    return copy.unionByName(target.select(key).join(source.select(key), key, "left_anti").withColumn("side", F.lit("delete")))
