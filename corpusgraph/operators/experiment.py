"""The experiment matrix: the same notes ingested, clustered, profiled and exported under each run's settings, and what came of it.

Every run has a store of its own, each step is one commit of it, and the summary counts what is stored there, so a run
that died can be counted, or gone on with from the step that failed.

No step shuffles texts: documents travel with their chunks where an augmentation needs them, tasks write the rows that they have,
and words find their cluster by its centre, not by a join.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusgraph.functions import config, models
from corpusgraph.operators import chunking, clusters, ingest, minibatch, retrieval
from corpusgraph.sources.store import Store

STEPS = ("sample", "ingest", "cluster", "profile", "export")
#: Tables of a run: columns and key.
TABLES = {
    "notes": ("source_file string, text string", ["source_file"]),
    "chunks": ("chunk_id string, source_file string, chunk_index int, text string, embed_text string, heading_path string, embedding array<double>", ["source_file"]),
    "members": ("chunk_id string, cluster_id int, distance double", ["chunk_id"]),
    "centres": ("cluster_id int, centre array<double>", ["cluster_id"]),
    "centroids": ("cluster_id int, centroid array<double>, size long", ["cluster_id"]),
    "profiles": ("cluster_id int, keywords array<string>, size long", ["cluster_id"]),
    "exports": ("kind string, json string", ["kind"]),
}


def _vectors(texts: pd.Series) -> pd.Series:
    x = chunking._sentence_vectors(texts.fillna("").tolist(), 32)
    norm = np.sqrt((x * x).sum(1))
    return pd.Series(list(x / np.where(norm == 0, 1, norm)[:, None]), index=texts.index, dtype=object)


#: Counts of words by a hash of them, of unit length: a stand-in for an embedding service.
hashed_words = F.pandas_udf(_vectors, ArrayType(DoubleType()))


def run(
    store: Store, notes: DataFrame, settings: dict, steps: tuple[str, ...] = STEPS, n_clusters: int = 20, share: float = 1.0,
    embed: Callable[[Column], Column] = hashed_words, write: Callable[[Column], Column] | None = None, dry_run: bool = False, clock: Callable[[], float] = time.time,
) -> dict:
    """One run over notes (source_file, text): its steps in order, and the row of the summary.

    ``sample`` takes a share of the files by a hash of their names; ``write`` answers prompts for augmented embeddings. A dry run
    does nothing but to check the steps. An unknown step is an error before any work.
    """
    if wrong := [s for s in steps if s.strip().lower() not in STEPS]:
        raise ValueError(f"unknown step {wrong[0]}; known are {', '.join(STEPS)}")
    began = clock()
    for name, (schema, key) in TABLES.items():
        store.ensure(name, schema, key, 4)
    work = {"sample": _sample, "ingest": _ingest, "cluster": _cluster, "profile": _profile, "export": _export}
    for s in [] if dry_run else [s.strip().lower() for s in steps]:
        change = store.begin()
        work[s](change, notes=notes, settings=settings, n_clusters=n_clusters, share=share, embed=embed, write=write)
        change.commit()
    ended = clock()
    count = lambda name: store.read(name).count()
    measured = {
        "started_at": began, "completed_at": ended, "duration_seconds": ended - began, "file_count": count("notes"), "chunk_count": count("chunks"),
        "cluster_count": store.read("members").select("cluster_id").distinct().count(), "profile_count": count("profiles"), "centroid_count": count("centroids"),
    }
    return config.run_summary(settings, measured)


def _whole(change, name: str, rows: DataFrame) -> None:
    """A table becomes these rows."""
    change.clear(name)
    change.append(name, rows, deal=False)


def _sample(change, notes, share, **_) -> None:
    _whole(change, "notes", notes.where(minibatch.chance("source_file", 0) < share) if share < 1 else notes)


def _ingest(change, settings, embed, write, **_) -> None:
    notes = change.read("notes")
    chunks = ingest.chunk(notes, "source_file", "text", settings["chunking_strategy"], "document" if write else None)
    document = F.col("document") if write else F.lit(None).cast("string")
    said = models.embed_text(settings["chunking_augmentation"], F.col("text"), document, write, int(settings["contextual_max_doc_chars"]))
    named = F.concat_ws("#", "source_file", F.col("chunk").cast("string"))
    rows = chunks.select(named.alias("chunk_id"), "source_file", F.col("chunk").alias("chunk_index"), "text", said.alias("embed_text"), "heading_path")
    _whole(change, "chunks", rows.withColumn("embedding", embed(F.col("embed_text"))))
    change.clear("centres")  # those were of other chunks


def _cluster(change, n_clusters, **_) -> None:
    chunks = change.read("chunks")
    centres = minibatch.centres(minibatch.points(chunks, "chunk_id", "embedding"), n_clusters, starts=1)
    for name in ("members", "centres", "centroids"):
        change.clear(name)
    if centres is not None:
        placed = _placed(chunks, centres)
        _whole(change, "members", placed.select("chunk_id", "cluster_id", "distance"))
        _whole(change, "centres", chunks.sparkSession.createDataFrame(list(enumerate(centres.tolist())), TABLES["centres"][0]))
        _whole(change, "centroids", clusters.centroids(placed, "cluster_id", "embedding").select("cluster_id", "centroid", "size"))


def _placed(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Chunks that have a vector, with ``cluster_id`` and ``distance``."""
    at = minibatch.place(F.col("embedding"), centres)
    return chunks.where(F.size("embedding") > 0).withColumn("_at", at).select("*", F.col("_at.cluster").alias("cluster_id"), F.col("_at.distance2").alias("distance"))


def _profile(change, **_) -> None:
    chunks = change.read("chunks")
    centres = np.array([r["centre"] for r in change.read("centres").orderBy("cluster_id").collect()], float)  # one a cluster
    if len(centres):
        members = _placed(chunks, centres).select("chunk_id", "text", "cluster_id")
    else:  # the chunks were ingested again since, or clustered before centres were stored
        members = chunks.select("chunk_id", "text").join(change.read("members").select("chunk_id", "cluster_id"), "chunk_id")
    words = retrieval.keywords(members, "cluster_id", "chunk_id", "text", 5)
    listed = words.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))  # five a cluster
    size = change.read("centroids").select("cluster_id", "size")
    _whole(change, "profiles", size.join(listed, "cluster_id", "left").select("cluster_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "size"))


def _export(change, **_) -> None:
    rows = lambda kind, name, *cols: change.read(name).select(F.lit(kind).alias("kind"), F.to_json(F.struct(*cols)).alias("json"))
    _whole(change, "exports", rows("profile", "profiles", "cluster_id", "keywords", "size").unionByName(rows("chunk", "members", "chunk_id", "cluster_id", "distance")))


def matrix(spark, stores: Callable[[str], Store], notes: DataFrame, plan: list[dict], **options) -> DataFrame:
    """The summaries of all runs of a plan, a row each, in the summary's columns."""
    rows = [run(stores(p["run_id"]), notes, p, **options) for p in plan]
    numbers = {"contextual_max_doc_chars": "int", "duration_seconds": "double", "started_at": "double", "completed_at": "double"}
    kind = lambda c: numbers.get(c, "long" if c.endswith("_count") else "string")
    return spark.createDataFrame([tuple(r[c] for c in config.SUMMARY) for r in rows], ", ".join(f"{c} {kind(c)}" for c in config.SUMMARY))
