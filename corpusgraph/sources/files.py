"""File sources: notes, mail, PDF files and ground truth, from any store that Spark reads."""

from __future__ import annotations

import email
import hashlib
from collections.abc import Iterator
from email import policy

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _note_files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return found.select("path", F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, modified_at) of all Markdown files below a folder that are UTF-8 and aren't blank."""
    return _note_files(spark, path).where(F.is_valid_utf8("raw") & (F.trim("raw") != "")).drop("size")


def unreadable_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified_at) of the Markdown files that aren't UTF-8."""
    return _note_files(spark, path).where(~F.is_valid_utf8("raw")).select("path", "size", "modified_at")


def _body(message) -> str:
    parts = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if part.is_multipart() or part.get_content_disposition() == "attachment" or kind not in parts:
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            parts[kind].append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
        except LookupError:
            parts[kind].append(raw.decode("utf-8", "replace"))
    return "\n".join(parts["text/plain"]) or "\n".join(parts["text/html"])


def parse_mail(raw: bytes, source: str) -> dict:
    """One message; empty headers are null, and the id falls back to a digest."""
    m = email.message_from_bytes(raw, policy=policy.default)
    head = {k: str(m[h] or "").strip() or None for k, h in (("subject", "subject"), ("sender", "from"), ("date", "date"), ("message_id", "message-id"))}
    body = _body(m)
    key = "|".join([head["subject"] or "", head["sender"] or "", head["date"] or "", body[:256]])
    return {**head, "body": body, "source_path": source, "unique_id": head["message_id"] or "hash-" + hashlib.sha256(key.encode()).hexdigest()}


MAIL_SCHEMA = "subject string, sender string, date string, message_id string, body string, source_path string, unique_id string"


#: The message lies between two lines that begin with this.
_FROM = "From "


def _archived(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, raw) of the messages of the .mbox files below a folder.

    Spark splits a file by bytes, and its text source finds where messages begin: a message is a record that ends with a line
    feed and ``From ``. A message's number in its file is its place in its split and the number of messages in the splits before.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][bB][oO][xX]").option("lineSep", "\n" + _FROM).text(path)
    rows = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("at"))
    # a row for each split of a file
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("low"), F.count("*").alias("n"), F.min_by(F.substring("raw", 1, len(_FROM)), "at").alias("head"))
    whole = Window.partitionBy("file").orderBy("block")
    bare = F.max(F.when((F.col("block") == 0) & (F.col("head") != F.lit(_FROM).cast("binary")), 1).otherwise(0)).over(Window.partitionBy("file"))
    splits = splits.select("file", "block", "low", (F.sum("n").over(whole) - F.col("n") - bare).alias("before"))
    named = F.regexp_replace(F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    placed = rows.join(splits, ["file", "block"]).withColumn("k", F.col("before") + F.col("at") - F.col("low")).where("k >= 0")
    return placed.select(F.concat(named, F.lit(":"), F.col("k").cast("string")).alias("source_path"), "raw")


def mail(spark: SparkSession, path: str) -> DataFrame:
    """One row per message of the .eml and .mbox files below a folder; a message of an archive is named by the file and its number."""
    single = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][mM][lL]").load(path).select(F.col("path").alias("source_path"), F.col("content").alias("raw"), F.lit(False).alias("archived"))
    both = single.unionByName(_archived(spark, path).withColumn("archived", F.lit(True)))
    names = [x.split()[0] for x in MAIL_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, raw, archived in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archived:  # the rest of the line that begins with From
                    raw = raw.partition(b"\n")[2]
                rows.append(parse_mail(raw, source))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string()) for n in names], names=names)

    return both.mapInArrow(run, MAIL_SCHEMA)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, relevant_docs) from a JSON file with a list of queries."""
    schema = "queries array<struct<id:string,query:string,relevant_docs:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def kept_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a state file, a JSON list; none where there is no file or it can't be read."""
    try:
        whole = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    fields = ",".join(x.strip().replace(" ", ":", 1) for x in schema.split(","))
    rows = F.from_json("value", f"array<struct<{fields}>>")
    return whole.where(F.try_parse_json("value").isNotNull()).select(F.explode(rows).alias("r")).select("r.*")
