"""Gates, ask policy, priorities and queues as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(confidence: Column, reject_below: float = 0.60, approve_from: float = 0.90) -> Column:
    return F.when(confidence < reject_below, "reject").when(confidence >= approve_from, "approve").otherwise("ask")


def ask_reason(state: dict[str, Column], confidence: Column, now: Column, max_asks: int = 3, cooldown: str = "INTERVAL 14 DAYS", rise: float = 0.15) -> Column:
    """Why a discovery is asked about or not; the first condition that holds decides."""
    return (
        F.when(state["known"].isNull(), "new").when(state["archived_at"].isNotNull(), "archived").when(state["ask_count"] >= max_asks, "asked_out")
        .when(state["snoozed_until"] > now, "snoozed").when(state["rejected_at"].isNotNull() & (now - state["rejected_at"] < F.expr(cooldown)), "cooldown")
        .when(confidence < state["rejected_confidence"] + rise, "not_risen").otherwise("ask")
    )


def pressure(work: Column, hours_left: Column, importance: Column, urgency: Column) -> Column:
    """Work per hour left, weighted; 999 when overdue; null inputs give null."""
    return F.when(hours_left <= 0, 999.0 + 0 * work * importance * urgency).otherwise(work / hours_left * importance * urgency)


def enrichment_stage(importance: Column, urgency: Column, deadline: Column) -> Column:
    return F.when(importance.isNull(), 1).when(urgency.isNull(), 2).when((importance + urgency >= 7) & deadline.isNull(), 3)


def backoff(attempts: Column, now: Column, base_seconds: int = 60, most: int = 3) -> Column:
    """Time of the next attempt after one more failure; null when there is none."""
    return F.when(attempts + 1 < most, now + F.make_dt_interval(secs=F.lit(base_seconds) * F.pow(F.lit(2), attempts)))


def after_asking(state: DataFrame, asked: DataFrame, key: str, now: Column) -> DataFrame:
    """The state (key, ask_count, asked_at) after a turn: every key asked about (asked) counts one more, new keys begin with one."""
    said = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    both = state.join(said, key, "full")
    count = F.coalesce("ask_count", F.lit(0)) + F.when(F.col("_asked"), 1).otherwise(0)
    return both.select(key, count.cast("long").alias("ask_count"), F.when(F.col("_asked"), now).otherwise(F.col("asked_at")).alias("asked_at"))
