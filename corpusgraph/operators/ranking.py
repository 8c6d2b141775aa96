"""Top-k and latest-row operators that spread hot groups before they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, salt: list[str], parts: int = 16, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the order given, with their rank.

    Each group is dealt over ``parts`` by a hash of the salt columns, cut to k rows there, and only those are ranked
    together: no task sees more than parts * k rows of a hot group in the last step.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*salt), F.lit(parts)))
    first = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_rank") <= k).drop("_rank", "_part")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns: an aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest order columns."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_best")).select(*keys, "_best.*").select(*df.columns)
