"""Ingesting: which files are new, what is written of them, chunks with their headings, strategies by name."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.functions import vectors as V
from corpusgraph.operators import chunking, state
from corpusgraph.operators.structure import outline
from corpusgraph.session import discard, materialise

CHUNK = "array<struct<chunk:int,start:bigint,text:string,heading_path:string,heading_level:int,section_title:string>>"


def scan(table: DataFrame, where: str, limit: int, order: list[str]) -> DataFrame:
    """A filtered scan with a hard limit, in an order that makes it the same each time."""
    return table.where(where).orderBy(*order).limit(limit)


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, modified, size) whose time and size are both exactly those of their state."""
    return files.join(known.select("path", "modified", "size"), ["path", "modified", "size"], "left_semi")


def readable(paths: list[str], suffixes: tuple[str, ...], exists: Callable[[str], bool]) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths to ingest, refused paths and why) for files that are named one by one."""
    good, bad = [], []
    for p in paths:
        why = "not found" if not exists(p) else "wrong kind" if not p.lower().endswith(suffixes) else None
        bad.append((p, why)) if why else good.append(p)
    return good, bad


def plan(files: DataFrame, known: DataFrame, mode: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to read, state to begin with) of a run: ``once`` reads what changed, ``again`` or force forgets the state first."""
    if mode not in ("once", "again", "watch"):
        raise ValueError(f"unknown mode {mode}")
    before = known.limit(0) if mode == "again" or force else known
    return files.join(unchanged(files, before).select("path"), "path", "left_anti"), before


def append_chunks(stored: DataFrame, chunks: DataFrame, optional: tuple[str, ...] = ("context_header", "doc_summary")) -> DataFrame:
    """Stored chunks and new ones, whose missing headers and summaries become empty texts."""
    return stored.unionByName(chunks.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in optional if c in chunks.columns}).select(*stored.columns))


def replace_source(stored: DataFrame, chunks: DataFrame, source: str, kind: str, kind_col: str = "source_type") -> DataFrame:
    """Stored chunks in which those of the sources that come again, of one kind, are replaced."""
    again = chunks.select(source).distinct().withColumn(kind_col, F.lit(kind))
    return stored.join(again, [source, kind_col], "left_anti").select(*stored.columns).unionByName(chunks.withColumn(kind_col, F.lit(kind)).select(*stored.columns))


def set_column(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """A table with one column set by key; rows without a new value keep theirs."""
    new = values.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def set_status(table: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """A table with a status set by key (the last of a key's changes) and the time of the change."""
    last = state.latest_per_key(changes, [key], [c for c in changes.columns if c != key])
    both = table.join(last.select(key, F.col("status").alias("_new")), key, "left")
    return both.withColumns({"updated_at": F.when(F.col("_new").isNotNull(), at).otherwise(F.col("updated_at")), "status": F.coalesce("_new", "status")}).select(*table.columns)


def lookup(keys: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The named fields of each key, and whether it exists."""
    return keys.select(key).distinct().join(table.select(key, *fields, F.lit(True).alias("_known")), key, "left").withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def ensure_schema(table: DataFrame, schema: StructType) -> DataFrame:
    """A table with all columns of a schema: missing ones are null, further ones stay. Bad names and other types are errors."""
    for f in schema:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f.name):
            raise ValueError(f"{f.name!r} is no name of a column")
        if f.name in table.columns and table.schema[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {table.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return table.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in table.columns})


def merge_metadata(metadata: Column, source: Column) -> Column:
    """A map of metadata in which the source is set."""
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: k != "source")
    return F.map_concat(own, F.create_map(F.lit("source"), source))


def subset(fields: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(fields, F.array(*map(F.lit, allowed)))) == 0


def clear(table: DataFrame, action: str, kind: str | None = None, kind_col: str = "type") -> DataFrame:
    """A table after one step of a reset: without the rows of a kind, or without any."""
    return table.where(F.coalesce(F.col(kind_col) != kind, F.lit(True))) if action == "delete_rows" else table.limit(0)


class Headings:
    """The headings of a note by place: what a piece that begins somewhere stands under."""

    def __init__(self, note: str):
        self.nodes = outline(note)
        self.starts = [n["start"] for n in self.nodes]

    def at(self, place: int) -> dict | None:
        """The deepest heading whose extent holds a place. Extents nest, so that is the last one that begins before it and hasn't ended."""
        k = bisect_right(self.starts, place) - 1
        return self.nodes[k] if k >= 0 and place < self.nodes[k]["end"] else None


def places(text: str, chunks: list[str], probe: int = 50) -> list[int]:
    """Where each chunk begins: its first characters after the chunk before, else the chunk anywhere, else right behind the one before."""
    out: list[int] = []
    for k, c in enumerate(chunks):
        at = text.find(c[:probe], out[-1] + 1) if k else text.find(c)
        if at < 0:
            at = text.find(c)
        out.append(at if at >= 0 else out[-1] + len(chunks[k - 1]) if k else 0)
    return out


def structured(text: str, split: Callable[[str], list[str]]) -> list[dict]:
    """Chunks with their place and heading."""
    if not text or not text.strip():
        return []
    chunks, heads, out = split(text), Headings(text), []
    for k, (c, at) in enumerate(zip(chunks, places(text, chunks), strict=True)):
        h = heads.at(at)
        out.append({"chunk": k, "start": at, "text": c, "heading_path": h["path"] if h else "", "heading_level": h["level"] if h else 0, "section_title": h["title"] if h else ""})
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of a text."""
    out, cursor = [], 0
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if s.strip() and (at := text.find(s, cursor)) >= 0:
            cursor = at + len(s)
            out.append((at, cursor))
    return out


def ask_json(answer: str | None) -> list[int] | None:
    """The boundaries that an answer states as JSON; None where it states none."""
    try:
        found = json.loads(answer or "").get("boundaries")
    except (ValueError, AttributeError):
        return None
    return [int(b) for b in found if isinstance(b, (int, float))] if isinstance(found, list) else None


def semantic_boundaries(text: str, same: Callable[[str, str], bool], propose: Callable[[str], str | None] | None = None, most: int = 1000, json_chars: int = 12_000) -> list[int]:
    """Where a text's topics change: as proposed in one answer (for texts of up to ``json_chars``), else sentence by sentence.

    Between paragraphs, and where a chunk would be longer than ``most``, there is a boundary in any case; elsewhere ``same``
    says whether a sentence goes on with the chunk so far.
    """
    if propose and len(text) <= json_chars and (found := ask_json(propose(text))) is not None:
        return found
    out, held, last = [], "", None
    for a, b in sentences(text):
        s = text[a:b]
        if last is not None:
            forced = "\n\n" in text[last:a] or len(held) + len(s) > most
            if forced or not same(held, s):
                out.append(a)
                held = ""
        held, last = f"{held} {s}" if held else s, b
    return out


def _never(_: str, __: str) -> bool:
    return True


def split_semantic(text: str, same: Callable[[str, str], bool] = _never, propose: Callable[[str], str | None] | None = None, cache: dict | None = None, key: str = "", least: int = 100, most: int = 1000) -> list[str]:
    """Chunks between semantic boundaries; a text of at most ``least`` is one chunk; any failure falls back to the recursive split.

    Boundaries are kept in ``cache`` under ``key`` where given.
    """
    if not text or not text.strip():
        return []
    if len(text) <= least:
        return [text]
    cuts = cache.get(key) if cache is not None else None
    if cuts is None:
        try:
            cuts = semantic_boundaries(text, same, propose, most)
        except Exception:  # a model that fails must not lose the document
            return chunking.split_recursive(text)
        if cache is not None:
            cache[key] = cuts
    return chunking.assemble(text, cuts, least, most)


def hybrid(text: str, split: Callable[[str], list[str]] = split_semantic, least: int = 1000) -> list[dict]:
    """Top-level sections as chunks, long ones split; a single top-level heading counts as the note itself, without what is before it."""
    if not text or not text.strip():
        return []
    nodes = outline(text)
    top = [n for n in nodes if n["parent"] is None]
    if not top:
        return [{"chunk": k, "start": -1, "text": c, "heading_path": "", "heading_level": 0, "section_title": ""} for k, c in enumerate(split(text))]
    out: list[dict] = []
    for n in top:
        section = text[n["start"] : n["end"]]
        if section.strip():
            for c in split(section) if len(section) >= least else [section]:
                out.append({"chunk": len(out), "start": -1, "text": c, "heading_path": n["path"], "heading_level": n["level"], "section_title": n["title"]})
    return out


#: Strategies by name: text -> chunks with headings where the strategy knows them.
STRATEGIES: dict[str, Callable[[str], list[dict]]] = {
    "recursive": lambda t: structured(t, chunking.split_recursive), "semantic": lambda t: structured(t, split_semantic), "semantic_cosine": lambda t: structured(t, chunking.split_by_similarity), "hybrid": hybrid,
}


def chunk(docs: DataFrame, id_col: str, text_col: str, strategy: str, document: str | None = None) -> DataFrame:
    """(id, chunk, start, text, heading_path, heading_level, section_title) by a strategy's name; an unknown one is an error.

    With ``document``, a column of that name has the whole text of each chunk's document, so that nobody joins it again.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known are {', '.join(STRATEGIES)}")
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    fields = pa.struct([("chunk", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("heading_path", pa.string()), ("heading_level", pa.int32()), ("section_title", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = STRATEGIES[strategy]
        for batch in batches:
            found = pa.array([split(t.as_py() or "") for t in batch.column(1)], pa.list_(fields))
            yield pa.RecordBatch.from_arrays([*(batch.columns if document else batch.columns[:1]), found], names=[*("_id", "_text")[: 2 if document else 1], "chunks"])

    kind = source.schema["_id"].dataType.simpleString()
    whole = [F.col("_text").alias(document)] if document else []
    found = source.mapInArrow(run, f"_id {kind}, {'_text string, ' if document else ''}chunks {CHUNK}")
    return found.select(F.col("_id").alias(id_col), *whole, F.explode("chunks").alias("c")).select(id_col, "c.*", *([document] if document else []))


def semantic_cached(docs: DataFrame, cache: DataFrame, id_col: str, text_col: str, same: Callable[[str, str], bool] = _never, propose: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks (id, chunk, text), new rows of the cache): semantic chunks, with boundaries from a table (key, cuts) where it has them.

    The key is a digest of the text. Only texts without a row are asked about, each distinct one once; their boundaries are the new
    rows, written before use, so that a model is asked once however often the result is read. A text for which it fails has no row.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    # keys first, so that texts go nowhere if the table has them all
    asked = rows.where(F.length("_text") > 100)
    keys = materialise(asked.select("_key").distinct().join(cache.select(F.col("key").alias("_key")), "_key", "left_anti"), "keys")
    none = keys.isEmpty()
    lacking = asked.limit(0).select("_key", "_text") if none else asked.groupBy("_key").agg(F.first("_text").alias("_text")).join(keys, "_key", "left_semi")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found.append((key, semantic_boundaries(text, same, propose)))
                except Exception:  # a model that fails must not lose the document
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["key", "cuts"])

    new = materialise(lacking.mapInArrow(ask, "key string, cuts array<int>"), "boundaries")
    discard(keys)
    known = cache.select(F.col("key").alias("_key"), F.col("cuts").cast("array<int>").alias("_cuts")).unionByName(new.select(F.col("key").alias("_key"), F.col("cuts").alias("_cuts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blank = not text or not text.strip()
                out.append([] if blank else [text] if len(text) <= 100 else chunking.split_recursive(text) if cuts is None else chunking.assemble(text, cuts, 100, 1000))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["_id", "chunks"])

    kind = rows.schema["_id"].dataType.simpleString()
    chunks = rows.join(known, "_key", "left").select("_id", "_text", "_cuts").mapInArrow(cut, f"_id {kind}, chunks array<string>")
    return chunks.select(F.col("_id").alias(id_col), F.posexplode("chunks").alias("chunk", "text")), new


def quality(docs: DataFrame, group: str, text: str, vector: str | None = None) -> DataFrame:
    """(group, n, mean, deviation, shortest, longest, boundary, coherence): sizes of a group's chunks, the share that ends a sentence, and how alike they are.

    Coherence is the mean cosine of all pairs of the group's vectors, from the sum of their unit vectors, so no pairs are made;
    0 for fewer than two, or without ``vector``. Chunks without a vector don't count there.
    """
    n = F.length(text)
    ends = F.avg(F.when(F.col(text).rlike(r"[.!?][\x09-\x0D\x20]*\z"), 1.0).otherwise(0.0))
    out = docs.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("deviation"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(ends, 6).alias("boundary")
    )
    if vector is None:
        return out.withColumn("coherence", F.lit(0.0))
    v = V.as_double(F.col(vector))
    units = docs.where((F.size(v) > 0) & (V.norm(v) > 0)).select(group, F.posexplode(F.transform(v, lambda x: x / V.norm(v))).alias("dim", "x"))
    square = units.groupBy(group, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("m")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("m").alias("m"))
    mean = F.when(F.col("m") > 1, F.round((F.col("s2") - F.col("m")) / (F.col("m") * (F.col("m") - 1)), 6)).otherwise(0.0)
    coherent = square.select(F.col(group).alias("_group"), mean.alias("coherence"))
    return out.join(coherent, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0))).drop("_group")


def preservation(chunks: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, preserved, depth): share of the expected headings (key, heading) that chunks' paths name, and share of paths whose level fits their last heading.

    Without expected headings, or without any path, the share is 1.
    """
    named = chunks.where("heading_path != ''").select(key, "heading_level", F.split("heading_path", " > ").alias("p"))
    found = named.select(key, F.explode("p").alias("heading")).withColumn("heading", F.trim(F.regexp_replace("heading", "^#+", ""))).distinct().withColumn("_in", F.lit(1))
    kept = expected.distinct().join(found, [key, "heading"], "left").groupBy(key).agg(F.round(F.avg(F.coalesce("_in", F.lit(0))), 6).alias("preserved"))
    level = F.length(F.regexp_extract(F.element_at("p", -1), "^(#*)", 1))
    depth = named.groupBy(key).agg(F.round(F.avg(F.when(level == F.col("heading_level"), 1.0).otherwise(0.0)), 6).alias("depth"))
    keys = chunks.select(key).distinct()
    return keys.join(kept, key, "left").join(depth, key, "left").select(key, F.coalesce("preserved", F.lit(1.0)).alias("preserved"), F.coalesce("depth", F.lit(1.0)).alias("depth"))

