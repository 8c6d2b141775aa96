"""Heading trees of notes, and the headings of chunks that were cut without them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
NODE = "array<struct<level:int,title:string,start:bigint,end:bigint,parent:bigint,path:string>>"


def outline(note: str) -> list[dict]:
    """The headings of a note; ``end`` is where the next one of the same or a higher rank starts, ``parent`` the start of the heading above."""
    out, open_ = [], []
    for m in HEADING.finditer(note):
        level = len(m[1])
        while open_ and open_[-1]["level"] >= level:
            open_.pop()["end"] = m.start()
        above = open_[-1] if open_ else None
        mark = f"{m[1]} {m[2].strip()}"
        node = {"level": level, "title": m[2].strip(), "start": m.start(), "end": len(note), "parent": above and above["start"], "path": f"{above['path']} > {mark}" if above else mark}
        out.append(node)
        open_.append(node)
    return out


def heading_tree(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node): one row per heading; null and empty notes have none."""
    source = notes.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    fields = pa.struct([("level", pa.int32()), ("title", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int64()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([outline(t.as_py() or "") for t in batch.column(1)], pa.list_(fields))], names=["_key", "nodes"])

    return source.mapInArrow(run, f"_key {kind}, nodes {NODE}").select(F.col("_key").alias(key), F.explode("nodes").alias("node"))


def backfill(chunks: DataFrame, notes: DataFrame, key: str, text: str, chunk: str, probe: int = 100) -> DataFrame:
    """Chunks with ``position``: where the chunk's first characters occur in its note (-1 where they don't)."""
    both = chunks.join(notes.select(key, F.col(text).alias("_note")), key, "left")
    at = F.expr(f"locate(substring({chunk}, 1, {probe}), _note)").cast("long") - 1
    return both.withColumn("position", F.coalesce(at, F.lit(-1).cast("long"))).drop("_note")
