"""Sinks: summaries as JSON and CSV with a fixed column order, graphs merged by id, project notes as files' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.config import SUMMARY
from corpusgraph.operators import state


def write_summary(df: DataFrame, path: str, columns: list[str] = SUMMARY) -> None:
    """A report table of few rows, in the columns' order (an experiment's by default); missing columns are null. Writes ``path``/json and ``path``/csv."""
    ordered = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).coalesce(1)
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ..., updated_at) are merged by id; all edges (source, target, ...) of a node that comes again are replaced.

    Edges whose ends aren't among the merged nodes are dropped.
    """
    merged = state.upsert(nodes, new_nodes, ["id"], ["updated_at"])
    kept = edges.join(new_nodes.select(F.col("id").alias("source")).distinct(), "source", "left_anti").unionByName(new_edges)
    ids = merged.select("id")
    kept = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return merged, kept.select(*edges.columns)
