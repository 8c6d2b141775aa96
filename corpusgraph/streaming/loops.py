"""Loops as streams: watched files, the outbox, limits over time windows, periodic jobs, progress."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgraph.functions import notes as N
from corpusgraph.operators import state
from corpusgraph.session import discard, materialise, shared_dir

#: Patterns of the watched kinds of files and how long each rests after an event (seconds).
WATCHED = {"vault": ("*.md", 2.0), "mail": ("*.{eml,mbox}", 5.0), "pdf": ("*.pdf", 5.0)}


def run_stream(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, appends to a table of the shared folder, and reads that."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def watch(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, content, modified_at, size) of the files of a kind below a folder as they come or change; hidden and temporary ones are left out."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", WATCHED[kind][0]).load(path)
    rows = found.select("path", "content", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    return rows.where(N.watched(F.col("path"))) if kind == "vault" else rows


def watch_all(spark: SparkSession, sources: dict[str, str], handle: Callable[[str, DataFrame], None], failed: Callable[[str, Exception], None], base: str) -> list:
    """Starts a stream for each enabled source (kind: folder; an empty folder disables it); a batch's files go to ``handle``.

    An error in handling goes to ``failed`` and does not end the stream.
    """
    started = []
    for kind, path in sources.items():
        if not path:
            continue

        def batch(rows: DataFrame, k: int, kind: str = kind) -> None:
            try:
                handle(kind, rows)
            except Exception as e:  # the next batch may fare better
                failed(kind, e)

        started.append(watch(spark, path, kind).writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/{kind}").trigger(processingTime=f"{WATCHED[kind][1]} seconds").start())
    return started


def commit_complete(rows: DataFrame, file: str, ok: str, partial: bool) -> tuple[DataFrame, DataFrame]:
    """(rows to store, files to mark as done): a file is done only if all of its rows succeeded.

    Of a file that isn't, the rows that did succeed are stored with ``partial`` (notes), else none (mail).
    """
    whole = rows.groupBy(file).agg(F.min(F.col(ok)).alias("_done"))
    done = whole.where("_done").select(file)
    good = rows.where(ok)
    return good if partial else good.join(done, file, "left_semi"), done


def fold_outbox(events: DataFrame, key: str, order: list[str], event: str, wants: str, most: int = 3) -> DataFrame:
    """(key, status, attempts) after all events of each message in their order.

    The events of one message are few (a message fails three times at most between two requeues that someone asked for).
    """
    def step(s, e):
        sent = F.when(e["w"], "awaiting_response").otherwise("delivered")
        tried = (s["attempts"] + 1).cast("long")
        pair = lambda status, n: F.struct(status.alias("status"), n.cast("long").alias("attempts"))
        return (
            F.when((s["status"] == "pending") & (e["e"] == "delivered"), pair(sent, s["attempts"])).when((s["status"] == "pending") & (e["e"] == "error"), pair(F.when(tried >= most, "failed").otherwise("pending"), tried))
            .when((s["status"] == "awaiting_response") & (e["e"] == "response"), pair(F.lit("delivered"), s["attempts"])).when((s["status"] == "failed") & (e["e"] == "requeue"), pair(F.lit("pending"), F.lit(0)))
            .otherwise(s)
        )

    log = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("e"), F.col(wants).alias("w")))).alias("log"))
    first = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"))
    return log.select(key, F.aggregate("log", first, step).alias("s")).select(key, "s.status", "s.attempts")


def outbox_stream(events: DataFrame, key: str, order: str, event: str, wants: str, most: int = 3) -> DataFrame:
    """The same over a stream: each batch's events of a message go on from its kept state; (key, status, attempts) as they change."""
    kind = events.schema[key].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = kept.get if kept.exists else ("pending", 0)
        for e, w in pd.concat(list(frames)).sort_values(order)[[event, wants]].itertuples(index=False):
            if status == "pending" and e == "delivered":
                status = "awaiting_response" if w else "delivered"
            elif status == "pending" and e == "error":
                attempts += 1
                status = "failed" if attempts >= most else "pending"
            elif status == "awaiting_response" and e == "response":
                status = "delivered"
            elif status == "failed" and e == "requeue":
                status, attempts = "pending", 0
        kept.update((status, attempts))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "attempts": [attempts]})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, status string, attempts long", "status string, attempts long", "append", GroupStateTimeout.NoTimeout)


def poll_outbox(pending: DataFrame, deliver: Callable[[DataFrame], DataFrame], now, limit: int = 10) -> DataFrame:
    """One turn of the delivery loop: the ``limit`` oldest due messages (message_id, created_at, next_attempt_at) and what became of each.

    ``deliver`` returns (message_id, error); a null error is a delivery.
    """
    due = pending.where(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)).orderBy("created_at", "message_id").limit(limit)
    return deliver(due).select("message_id", F.when(F.col("error").isNull(), "delivered").otherwise("error").alias("event"), "error")


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by fixed window over a stream or a table; a stream's windows close when its watermark has passed them."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class Jobs:
    """Periodic jobs with injected clocks: each runs when it never did or its interval has passed."""

    def __init__(self, jobs: dict[str, tuple[float, Callable[[], None]]], now: Callable[[], float] = time.time):
        self.jobs, self.now, self.last, self.errors = jobs, now, {}, {}

    def turn(self) -> list[str]:
        """Runs what is due; the names of the jobs that ran. An error is kept and doesn't stop the others."""
        ran = []
        for name, (seconds, job) in self.jobs.items():
            t = self.now()
            if name in self.last and t - self.last[name] < seconds:
                continue
            self.last[name] = t
            ran.append(name)
            try:
                job()
                self.errors.pop(name, None)
            except Exception as e:  # the other jobs go on
                self.errors[name] = str(e)
        return ran


class Progress(StreamingQueryListener):
    """Rows so far, rate and time left of a stream whose input size is known."""

    def __init__(self, total: int, now: Callable[[], float] = time.time):
        self.total, self.now, self.done, self.began = total, now, 0, now()

    def onQueryStarted(self, event) -> None:
        self.began = self.now()

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, rows: int) -> dict:
        self.done += rows
        return self.report()

    def report(self) -> dict:
        spent = self.now() - self.began
        rate = self.done / spent if spent > 0 else 0.0
        return {"done": self.done, "percent": int(100 * self.done / self.total) if self.total else 100, "rate": rate, "seconds_left": (self.total - self.done) / rate if rate else None}


def ingest_batches(rows: DataFrame, known: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One turn of an ingest with a state table: (rows whose key is new, the keys known after it), both as written tables."""
    new = materialise(state.first_per_key(rows, [key], order).join(known.select(key), key, "left_anti").select(*rows.columns), "new")
    after = materialise(known.select(key).unionByName(new.select(key)), "known")
    return new, after


def forget(*tables: DataFrame) -> None:
    """Clears state tables for a run that takes everything in again."""
    discard(*tables)
