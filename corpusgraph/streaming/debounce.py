"""Debounce: an event is processed if the last *processed* event of its key is at least a delay older."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgraph.operators.rounds import ranked
from corpusgraph.session import discard, materialise


def debounce_batch(events: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """Batch form: keys are dealt to tasks and sorted there, and one pass keeps only the last processed time of the key at hand."""
    names = events.columns
    k, t = names.index(key), names.index(at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in batches:
            keep = []
            for row in frame.itertuples(index=False):
                fresh = row[k] != now or (row[t] - last).total_seconds() >= seconds
                if fresh:
                    now, last = row[k], row[t]
                keep.append(fresh)
            yield frame[keep]

    return events.where(f"{key} is not null and {at} is not null").repartition(key).sortWithinPartitions(key, at, order).mapInPandas(run, events.schema)


def debounce_linked(events: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """The same where one key may hold most events: nothing is done key by key.

    Each event is linked to the first of its key that is the delay later. That one lies in the next stretch of one delay's length or
    is the first of a later stretch, so events meet by key and stretch. From the first event of each key the links are
    followed by doubling: as many rounds as the logarithm of the longest chain, each two joins.
    """
    wait = round(seconds * 1_000_000)
    rows = ranked(events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))), F.col(key), F.col("_us"), F.col(order), rank="_rank")
    e = rows.select(F.col(key).alias("k"), "_us", "_rank")
    slab = lambda us: F.floor(us / wait) if wait else us
    own = e.select("k", slab(F.col("_us")).alias("slab"), F.col("_us").alias("us"), F.lit(1).alias("kind"), F.col("_rank").alias("event"), F.lit(None).cast("long").alias("probe"))
    probes = e.select("k", (slab(F.col("_us")) + 1).alias("slab"), (F.col("_us") + wait).alias("us"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event"), F.col("_rank").alias("probe"))
    both = own.unionByName(probes)
    # from the last row backwards: a frame that begins at the current row is read anew for each row, which is quadratic
    ahead = Window.partitionBy("k", "slab").orderBy(*[F.desc(c) for c in ("us", "kind", "event", "probe")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("next", F.last("event", ignorenulls=True).over(ahead)).where("kind = 0").select("k", "slab", "probe", "next")
    # stretches of a key, in order: one row each, however many events they hold
    later = Window.partitionBy("k").orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    first = both.groupBy("k", "slab").agg(F.min("event").alias("first")).withColumn("after", F.last("first", ignorenulls=True).over(later))
    links = near.join(first.select("k", "slab", "after"), ["k", "slab"]).select(F.col("probe").alias("a"), F.coalesce("next", "after").alias("b")).where("b is not null")
    jump, reached = materialise(links, "links"), materialise(e.groupBy("k").agg(F.min("_rank").alias("r")).select("r"), "reached")
    while not jump.isEmpty():
        more = reached.join(jump, F.col("r") == F.col("a")).select(F.col("b").alias("r"))
        grown = materialise(reached.unionByName(more), "reached")
        far = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        doubled = materialise(far, "links")
        discard(jump, reached)
        jump, reached = doubled, grown
    out = materialise(rows.join(reached, F.col("_rank") == F.col("r"), "left_semi").select(*events.columns), "debounced")
    discard(rows, jump, reached)
    return out


def debounce_stream(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Streaming form; the state of a key is its last processed time."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)

    def run(keys: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(at)
        keep = []
        for x in rows[at]:
            stamp = x.timestamp()
            keep.append(last is None or stamp - last >= seconds)
            last = stamp if keep[-1] else last
        state.update((last,))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within the delay: exactly-once ingestion of mail and files."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
