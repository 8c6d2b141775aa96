"""The outbox as a stateful stream with timers: failed messages come again when they are due, and the third failure is a dead letter.

Events of a message are kept until the watermark has passed them and then applied in order of time, so the result doesn't depend on
how the events are cut into batches, or on their order within the watermark's delay. A failure sets the time of the next
attempt (60 s, doubled with each); when the watermark passes that time and nothing became of the message before, it comes
out as ``due``. A message that fails ``most`` times comes out as ``dead``; a requeue takes it back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds until the second attempt; each further one waits twice as long.
FIRST_WAIT, MOST = 60, 3
OUT = "kind string, status string, attempts long, at timestamp, place long"


def step(state: list, event: str, wants: bool, at: float, first_wait: float = FIRST_WAIT, most: int = MOST) -> str | None:
    """One event of a message with state [status, attempts, next attempt]; ``dead`` if it fails for good."""
    status, attempts, _ = state
    if status == "pending" and event == "delivered":
        state[:] = ["awaiting_response" if wants else "delivered", attempts, None]
    elif status == "pending" and event == "error":
        attempts += 1
        state[:] = ["failed", attempts, None] if attempts >= most else ["pending", attempts, at + first_wait * 2 ** (attempts - 1)]
        return "dead" if attempts >= most else None
    elif status == "awaiting_response" and event == "response":
        state[:] = ["delivered", attempts, None]
    elif status == "failed" and event == "requeue":
        state[:] = ["pending", 0, None]
    return None


def advance(state: list, events: list[tuple], upto: float) -> tuple[list[tuple], list[tuple]]:
    """(what comes out, events that are later than ``upto``): applies (at, order, event, wants) in their order up to a time, timers between them."""
    out, rest, before = [], [], list(state[:2])
    for at, order, event, wants in sorted(events):
        if at > upto:
            rest.append((at, order, event, wants))
            continue
        if state[2] is not None and state[2] < at:
            out.append(("due", state[0], state[1], state[2], None))
            state[2] = None
        if step(state, event, wants, at):
            out.append(("dead", state[0], state[1], at, order))
        if state[:2] != before:
            out.append(("status", state[0], state[1], at, order))
            before = list(state[:2])
    if state[2] is not None and state[2] <= upto:
        out.append(("due", state[0], state[1], state[2], None))
        state[2] = None
    return out, rest


class Retries(StatefulProcessor):
    """State of a message: status, attempts and next attempt, and the events that the watermark hasn't passed, as JSON."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("message", "state string, events string")

    def _load(self) -> tuple[list, list[tuple]]:
        if not self.kept.exists():
            return ["pending", 0, None], []
        state, events = self.kept.get()
        return json.loads(state), [tuple(e) for e in json.loads(events)]

    def _save(self, state: list, events: list[tuple]) -> None:
        self.kept.update((json.dumps(state), json.dumps(events)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = min([e[0] for e in events] + ([state[2]] if state[2] is not None else []), default=None)
        if wake is not None:
            self.handle.registerTimer(int(wake * 1000) + 1)

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        for kind, status, attempts, at, place in out:
            yield Row(**{self.key: key[0]}, kind=kind, status=status, attempts=attempts, at=datetime.fromtimestamp(at, timezone.utc).replace(tzinfo=None), place=place)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, events = self._load()
        for r in rows:
            events.append((r["at"], r["order"], r["event"], bool(r["wants"])))
        out, rest = advance(state, events, timerValues.getCurrentWatermarkInMs() / 1000)
        self._save(state, rest)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, events = self._load()
        out, rest = advance(state, events, timerValues.getCurrentWatermarkInMs() / 1000)
        self._save(state, rest)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def outbox_retries(events: DataFrame, key: str, at: str, order: str, event: str, wants: str, late: str = "10 minutes") -> DataFrame:
    """(key, kind, status, attempts, at, place) of a stream of events: ``status`` where a message's status changes, ``due`` and ``dead``.

    ``place`` is the order of the event that did it.

    ``late`` is how much later than others an event may come. The session's state store becomes the one that has timers.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = events.withWatermark(at, late).select(key, F.col(at), F.unix_micros(F.col(at)).cast("double").alias("_us"), F.col(order).cast("long").alias("order"), F.col(event).alias("event"), F.coalesce(F.col(wants), F.lit(False)).alias("wants"))
    source = source.withColumn("_s", F.col("_us") / 1_000_000).select(key, F.col(at).alias("_at"), F.col("_s").alias("at"), "order", "event", "wants")
    kind = events.schema[key].dataType.simpleString()
    return source.groupBy(key).transformWithState(Retries(key), f"{key} {kind}, {OUT}", "append", "eventTime")


def fold_retries(events: DataFrame, key: str, at: str, order: str, event: str, wants: str, upto) -> DataFrame:
    """The same rows from a table of events, up to a time: what the stream gives once its watermark stands there."""

    def run(rows):
        import pandas as pd

        state = ["pending", 0, None]
        log = [(t, o, e, bool(w)) for t, o, e, w in zip(rows["at"], rows["order"], rows["event"], rows["wants"], strict=True)]
        out, _ = advance(state, log, rows["upto"].iloc[0])
        return pd.DataFrame([(rows[key].iloc[0], *o[:3], pd.Timestamp(o[3], unit="s"), o[4]) for o in out], columns=[key, "kind", "status", "attempts", "at", "place"]).astype({"place": "Int64"})

    seconds = lambda c: F.unix_micros(c) / 1_000_000
    source = events.select(key, seconds(F.col(at)).alias("at"), F.col(order).cast("long").alias("order"), F.col(event).alias("event"), F.coalesce(F.col(wants), F.lit(False)).alias("wants"), seconds(upto).alias("upto"))
    return source.groupBy(key).applyInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, {OUT}")
